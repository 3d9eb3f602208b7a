"""WARC archives and a two-level capture index.

Tasks write their rows as gzip members, one per record, into archives in the
shared folder. The captures are sorted by URL key, host reversed, dealt out by
ranges into shards and put in compressed blocks; the first key of each block
makes the sparse directory. A lookup finds its shard, searches the directory
and then the block, and reads the record's range of the archive alone.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import scratch_path, written

#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Records of one archive within so many bytes are read together, and as many tasks read as all bytes ask for.
READ_BYTES = 4 << 20
BLOCK_LINES = 256
#: A shard has at least so many captures, and there are at most so many shards: the directory's first level is bounded.
SHARD_CAPTURES, MOST_SHARDS = 50_000, 20_000


def url_key(url: str | None) -> str:
    """The URL with its host reversed: http://Blog.x.com:80/a?b#c is com,x,blog)/a?b. Null and what is no URL are left as they are, but that a newline is %0A: the index holds a key a line."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname, parts.port
    except ValueError:
        return (url or "").replace("\n", "%0A")
    if not host:
        return (url or "").replace("\n", "%0A")
    shown = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with refers_to a revisit, which holds no payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": date, "WARC-Target-URI": _one_line(url or "")}
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    head["WARC-Payload-Digest"] = f"sha1:{base32_sha1(payload)}"
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": name(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; the payload's digest is checked where the record holds it."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this is no WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    return head, payload


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass(frozen=True)
class Archive:
    """captures: url_key, page_id, file, start, size of each record. blocks: the index, by shard. bounds: the first key of each shard. size: bytes of all records."""

    captures: DataFrame
    blocks: DataFrame
    bounds: list[tuple[str, int]]
    size: int


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row and gives its capture: url_key, page_id, file, start, size.

    Of rows with equal payloads of at least min_bytes the one with the largest
    id is the response, the others are revisits of it; a null html is an empty
    payload, and rows with a null id are responses. An archive's name is new
    for each attempt of a task, so one that ran again leaves no wrong ranges.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha2("html", 256), "n": F.octet_length("html")})
    groups = rows.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("rows"))
    groups = groups.where("rows > 1").select("sha", "first")
    named = rows.join(groups, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    folder = scratch_path(pages.sparkSession, "archives")

    def run(batches):
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        file, out, at = "", None, 0
        for batch in batches:
            found = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    file, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{file}", compression=None)
                member = gzip_member(record(page_id, url, html.encode(), refers_to, date))
                out.write(member)
                found.append((url_key(url), page_id, f"{folder}/{file}", at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out = out.close()
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["url_key", "page_id", "file", "start", "size"])
        if out is not None:
            out.close()

    return written(named.mapInArrow(run, "url_key string, page_id long, file string, start long, size long"), "captures")


def build_index(captures: DataFrame) -> Archive:
    """Sorted captures in shards and compressed blocks, and the first key of each shard.

    A null id sorts before all others of its URL, as the least 64-bit number.
    """
    spark = captures.sparkSession
    n, size = captures.agg(F.count("*"), F.sum("size")).first()
    shards = max(1, min(-(-n // SHARD_CAPTURES), MOST_SHARDS))
    keyed = captures.withColumn("id", F.coalesce("page_id", F.lit(-(2**63))))
    ranged = keyed.select("url_key", "id", "file", "start", "size").repartitionByRange(shards, "url_key", "id").sortWithinPartitions("url_key", "id", "file", "start")

    def run(batches):
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId(), []

        def block(lines: list[tuple]) -> tuple:
            text = "\n".join("\t".join([*(str(x) for x in line[1:]), line[0]]) for line in lines)
            return shard, lines[0][0], lines[0][1], len(lines), zlib.compress(text.encode(), 6)

        def batch_of(blocks: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)], names=["shard", "first_key", "first_id", "n", "data"])

        for batch in batches:
            held += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            whole = len(held) // BLOCK_LINES * BLOCK_LINES
            if whole:
                yield batch_of([block(held[i : i + BLOCK_LINES]) for i in range(0, whole, BLOCK_LINES)])
                held = held[whole:]
        if held:
            yield batch_of([block(held)])

    blocks = written(ranged.mapInArrow(run, "shard int, first_key string, first_id long, n int, data binary"), "index")
    firsts = blocks.groupBy("shard").agg(F.min(F.struct("first_key", "first_id")).alias("first")).orderBy("shard").collect()
    return Archive(captures, blocks, [(r["first"]["first_key"], r["first"]["first_id"]) for r in firsts], size or 0)


def look_up(index: Archive, wanted: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """file, start, size of the captures of each distinct (url, page_id) of wanted; one that is not there gives no row."""
    bounds = index.bounds

    def route(batches):
        for batch in batches:
            keys = [(url_key(u), -(2**63) if i is None else i) for u, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            shard = [max(0, bisect.bisect_right(bounds, k) - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())], names=["shard", "key", "id"])

    routed = wanted.select(F.col(url_col).cast("string"), F.col(id_col).cast("long")).distinct().mapInArrow(route, "shard int, key string, id long")

    def search(key, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["first_key", "first_id"], ignore_index=True)
        directory = list(zip(blocks["first_key"], blocks["first_id"], strict=True))
        opened: dict[int, tuple[list, list]] = {}

        def block(i: int) -> tuple[list, list]:
            if i not in opened:
                lines = [line.split("\t", 4) for line in zlib.decompress(blocks["data"][i]).decode().split("\n")]
                opened[i] = [(line[4], int(line[0])) for line in lines], lines
            return opened[i]

        found = []
        for k in sorted(set(zip(asked["key"], asked["id"], strict=True))):
            i = max(0, bisect.bisect_left(directory, k) - 1)  # the same key may begin in the block before
            while i < len(directory) and (directory[i] <= k or not i):
                keys, lines = block(i)
                j = bisect.bisect_left(keys, k)
                while j < len(keys) and keys[j] == k:
                    found.append((lines[j][1], int(lines[j][2]), int(lines[j][3])))
                    j += 1
                i += 1
        return pd.DataFrame(found, columns=["file", "start", "size"])

    return routed.groupBy("shard").cogroup(index.blocks.groupBy("shard")).applyInPandas(search, "file string, start long, size long")


def read_records(places: DataFrame, size: int) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of the records at (file, start, size).

    A revisit's payload and payload_bytes are null here; resolve() adds them.
    size is about how many bytes they have together. Places take few bytes
    themselves, so the number of tasks is told and not left to Spark.
    """
    dealt = places.repartition(max(1, min(-(-size // READ_BYTES), 100_000)), "file", F.floor(F.col("start") / READ_BYTES)).sortWithinPartitions("file", "start")

    def run(batches):
        name, source = None, None
        for batch in batches:
            out = []
            for file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    store, path = fs.FileSystem.from_uri(file)
                    name, source = file, store.open_input_file(path)
                head, payload = parse(zlib.decompress(source.read_at(size, start), 31))
                full = head["WARC-Type"] == "response"
                ids = [int(head[k]) if k in head else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
                out.append((ids[0], head["WARC-Target-URI"], head["WARC-Type"], ids[1], head["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload) if full else None, payload if full else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return dealt.select("file", "start", "size").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """records without the payloads; a revisit's payload_bytes are those of the response that it refers to."""
    facts = written(records.drop("payload"), "records")
    full = facts.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full_bytes")).distinct()
    return facts.join(full, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes of each row of pages, as its archive gives it back.

    Pages whose url and id are both repeated come back once for each record.
    """
    index = build_index(write_archives(pages, min_bytes))
    return resolve(read_records(look_up(index, pages), index.size))
