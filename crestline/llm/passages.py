"""Removal of passages that an earlier document has, by automata of the passages.

A window is a fixed number of consecutive words. Each task hashes the windows of
its documents and deals the hashes out by range, sorted and packed, with the
document and the word that they begin at. A range tells which windows recur, the
smallest document that has each, and which later documents have it too. Those
first documents are then cut into passages, the runs of windows that are wanted
from them, and each later document goes to a shard with the passages that it
shares. A shard compiles its passages, cut into short blocks, into Aho-Corasick
automata and streams its documents through them; a hit is extended to both sides
as far as the words agree. So the hashes only propose: a word is removed where
document and passage agree word by word.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.bpe import slices
from crestline.llm.common import written
from crestline.llm.membership import Sieve
from crestline.llm.minhash import _mix

_PACKED = pa.Codec("zstd")
_ROWS = "range long, packed binary"


@dataclass(frozen=True)
class Passages:
    """words: those of a window; range_chars: text whose windows one range gets.

    A range's hashes have 48 bits besides those that name the range, so with
    about a million windows each a window meets another by chance once in
    10^8, at every size of the corpus. cut: windows of a document that are
    told apart when passages are handed out, 126 at most; automaton_words:
    words of the passages in one automaton; fan_out: ranges that rows are
    dealt out to at once.
    """

    words: int = 13
    range_chars: int = 8_000_000
    cut: int = 126
    automaton_words: int = 400_000
    fan_out: int = 1024

    @property
    def block(self) -> int:
        """Words in a block: at this length each window of a passage holds a whole block of those laid end to end."""
        return (self.words + 1) // 2


def split_words(text: str | None) -> list[str]:
    """The words of a text, parted by space and the five control characters that are white space."""
    joined = b" ".join((text or "").encode(errors="replace").split())
    return joined.decode().split(" ") if joined else []


def window_hashes(found: list[str], k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    if len(found) < k:
        return np.zeros(0, dtype=np.uint64)
    power = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    out, done, width = power, 0, 1
    # Runs of 1, 2, 4, ... words, put together by the bits of k.
    while True:
        if k & width:
            out = _join(out, power[done:]) if done else power
            done += width
        if done == k:
            return out
        power, width = _join(power, power[width:]), 2 * width


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return _mix(a[:n] * np.uint64(0x9E3779B97F4A7C15) + b[:n])


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first sorted: its steps and the others' offsets by byte planes, which compress to about their information."""
    lows = [0, *(int(c.min()) for c in columns[1:])]
    steps = [np.diff(columns[0], prepend=np.uint64(0)), *((c - low).view(np.uint64) for c, low in zip(columns[1:], lows[1:], strict=True))]
    raw = b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in steps)
    return struct.pack(f"<qq{len(lows)}q", len(lows), len(columns[0]), *lows) + _PACKED.compress(raw, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    k, n = struct.unpack_from("<qq", packed)
    lows = struct.unpack_from(f"<{k}q", packed, 16)
    raw = np.frombuffer(_PACKED.decompress(packed[16 + 8 * k :], decompressed_size=8 * k * n, asbytes=True), dtype=np.uint8).reshape(k, 8, n)
    first, *others = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in raw)
    return [np.cumsum(first, dtype=np.uint64), *(c.view(np.int64) + low for c, low in zip(others, lows[1:], strict=True))]


def _ranges(columns: list[np.ndarray], shift: int) -> list[tuple[int, bytes]]:
    """(range, packed rows) of columns sorted by the first; a range is named by the bits of that above shift."""
    if not len(columns[0]):
        return []
    which = (columns[0] >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(columns[0]), dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    return [(int(which[i]), _pack([c[i:j] for c in columns])) for i, j in zip(starts, [*starts[1:], len(which)], strict=True)]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["range", "packed"])


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for which, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield which, packed.as_py()


def _first_of(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorts by hash, id and place; also where each hash begins, and at each row the row of its hash's smallest id."""
    order = np.lexsort((at, ids, hashes))
    hashes, ids, at = hashes[order], ids[order], at[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, dtype=np.int64)
    return hashes, ids, at, starts, np.repeat(starts, np.diff(np.r_[starts, len(hashes)]))


def _later(ids: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """(key, owner, at, target) of each window that a later document shares with its first, sorted by key, a hash of the target."""
    later = np.flatnonzero(ids > ids[first]) if len(ids) else np.zeros(0, dtype=np.int64)
    target = ids[later]
    key = _mix(target.view(np.uint64))
    order = np.argsort(key, kind="stable")
    return [key[order], ids[first[later]][order], at[first[later]][order], target[order]]


def _windows(docs: DataFrame, how: Passages, shift: int, drop: int) -> DataFrame:
    """The distinct windows of each slice of documents with the smallest id there, by range; below 0, what its other documents share with those."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, texts in slices(batch, 1):
                found = [window_hashes(split_words(t), how.words) >> np.uint64(drop) for t in texts]
                sizes = [len(h) for h in found]
                if not sum(sizes):
                    continue
                of = np.repeat(ids[start : start + len(texts)], sizes)
                hashes, of, at, starts, first = _first_of(np.concatenate(found), of, np.concatenate([np.arange(n) for n in sizes]))
                shared = _later(of, at, first)
                # Dealt out like the rest: it is as large as what the slice repeats of itself.
                own = [(-1 - int(hashes[len(hashes) // 2] % np.uint64(1 << 30)), _pack(shared))] if len(shared[0]) else []
                yield _batch(own + _ranges([hashes[starts], of[starts], at[starts]], shift))

    return docs.mapInArrow(run, _ROWS)


def _dealt(rows: DataFrame, bits: int, whole: int, how: Passages) -> DataFrame:
    """Packed rows by ranges of the first `bits` bits of `whole`, from ranges of fewer: a task writes to how.fan_out of them at once."""
    step = how.fan_out.bit_length() - 1
    for level in [*range(2 * step, bits, step), *([bits] if bits > step else [])]:

        def run(batches, shift=whole - level):
            for which, packed in _packed_rows(batches):
                yield _batch([(which, packed)] if which < 0 else _ranges(_unpack(packed), shift))

        rows = rows.repartition("range").mapInArrow(run, _ROWS)
    return rows.repartition("range").sortWithinPartitions("range")


def asked_windows(docs: DataFrame, how: Passages) -> DataFrame:
    """(shard, owner, cut, low, high).

    docs has id, not null, and text. A row says which windows of a cut of the
    document owner, as bits, are also in later documents of the shard. Such a
    later document has a row of its own with its id as owner and cut -1. The
    owner is the smallest document that has the window, or, for documents
    that one slice of a task holds, the smallest of the slice: it is smaller
    than they are, and that is what counts.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = max(0, (int(chars) // how.range_chars).bit_length())
    drop = max(0, 16 - bits)  # 48 bits and those of the range
    coarse = min(bits, how.fan_out.bit_length() - 1)
    windows = _dealt(_windows(docs, how, 64 - drop - coarse, drop), bits, 64 - drop, how)

    def settled(batches):
        # A range is held whole; its size is bounded by range_chars, as a slice sends a window once.
        key, held, waiting, n = None, [], [], 0
        for which, packed in _packed_rows(batches):
            if which < 0:
                yield _batch(_ranges(_unpack(packed), 64 - coarse))
                continue
            if which != key and held:
                _, ids, at, _, first = _first_of(*(np.concatenate(c) for c in zip(*map(_unpack, held), strict=True)))
                waiting.append(_later(ids, at, first))
                n, held = n + len(waiting[-1][0]), []
            if n > 1_000_000:
                yield _batch(_ranges(_sorted(waiting), 64 - coarse))
                waiting, n = [], 0
            key = which
            held.append(packed)
        if held:
            _, ids, at, _, first = _first_of(*(np.concatenate(c) for c in zip(*map(_unpack, held), strict=True)))
            waiting.append(_later(ids, at, first))
        if waiting:
            yield _batch(_ranges(_sorted(waiting), 64 - coarse))

    shared = _dealt(windows.mapInArrow(settled, _ROWS), bits, 64, how)

    def asked(batches):
        key, held = None, []
        for which, packed in _packed_rows(batches):
            if which != key and held:
                yield _asked(key, held, how)
                held = []
            key = which
            held.append(packed)
        if held:
            yield _asked(key, held, how)

    return shared.mapInArrow(asked, ", ".join(f"{c} long" for c in _ASKED))


_ASKED = ["shard", "owner", "cut", "low", "high"]


def _sorted(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _asked(shard: int, held: list[bytes], how: Passages) -> pa.RecordBatch:
    _, owner, at, target = (np.concatenate(c) for c in zip(*map(_unpack, held), strict=True))
    order = np.lexsort((at, owner))
    owner, (cut, bit) = owner[order], np.divmod(at[order], how.cut)
    starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (cut[1:] != cut[:-1])])
    half, one = how.cut // 2, np.int64(1)
    low = np.where(bit < half, one << np.minimum(bit, half - 1), 0)
    high = np.where(bit >= half, one << np.maximum(bit - half, 0), 0)
    targets = np.unique(target)
    none, last = np.zeros(len(targets), dtype=np.int64), np.full(len(targets), -1, dtype=np.int64)
    masks = [np.r_[np.bitwise_or.reduceat(m, starts), none] for m in (low, high)]
    columns = [np.r_[owner[starts], targets], np.r_[cut[starts], last], *masks]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), shard, dtype=np.int64)), *map(pa.array, columns)], names=_ASKED)


def _runs(low: int, high: int, how: Passages) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of set bits."""
    half = how.cut // 2
    bits, i = low | high << half, 0
    while bits:
        skip = (bits & -bits).bit_length() - 1
        i, bits = i + skip, bits >> skip
        n = (~bits & (bits + 1)).bit_length() - 1
        yield i, i + n - 1
        i, bits = i + n, bits >> n


def _passage_texts(docs: DataFrame, wanted: DataFrame, how: Passages) -> DataFrame:
    """owner, cut, words: of each wanted cut of a document its words, joined by one space, from its first window to the end of its last."""

    def run(batches):
        for batch in batches:
            cuts = batch.column(2).to_pylist()
            for start, texts in slices(batch, 1):
                rows = []
                for owner, text, own in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts, cuts[start:], strict=False):
                    found = split_words(text)
                    for cut in own:
                        piece = found[cut * how.cut : (cut + 1) * how.cut + how.words - 1]
                        if len(piece) >= how.words:
                            rows.append((owner, cut, " ".join(piece)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "cut", "words"])

    # A document's cuts are no more than it has windows for.
    cuts = written(wanted.groupBy("owner").agg(F.collect_set("cut").alias("cuts")), "owners")
    may = Sieve(cuts.select("owner"), "owner").may_hold(F.col("id"))
    near = docs.where(may).join(cuts.hint("merge"), F.col("id") == F.col("owner")).select("owner", "text", "cuts")
    return near.mapInArrow(run, "owner long, cut long, words string")


class Automaton:
    """Blocks of a bounded number of passages, and where in them each block lies."""

    def __init__(self, passages: list[tuple[int, list[str]]], how: Passages):
        import ahocorasick

        self.passages, self.how = passages, how
        places: dict[str, list[tuple[int, int]]] = {}
        for p, (_, found) in enumerate(passages):
            for at in range(0, len(found) - how.block + 1, how.block):
                places.setdefault(f" {' '.join(found[at : at + how.block])} ", []).append((p, at))
        self.places, self.blocks = list(places.values()), ahocorasick.Automaton()
        for i, text in enumerate(places):
            self.blocks.add_word(text, i)
        self.blocks.make_automaton()

    def mark(self, doc: int, found: list[str], removed: np.ndarray) -> None:
        """Sets removed at each word of a window that a passage of a smaller document has."""
        if not self.places or len(found) < self.how.words:
            return
        # The place of the space before each word, and of the one behind the last.
        spaces = list(accumulate((len(w) + 1 for w in found), initial=0))
        done: dict[tuple[int, int], int] = {}
        for end, value in self.blocks.iter(f" {' '.join(found)} "):
            word = bisect_left(spaces, end) - self.how.block
            for p, at in self.places[value]:
                owner, passage = self.passages[p]
                if owner >= doc or done.get((p, word - at), -1) > word:
                    continue
                i, j = word, at
                while i and j and found[i - 1] == passage[j - 1]:
                    i, j = i - 1, j - 1
                stop, k = word + self.how.block, at + self.how.block
                while stop < len(found) and k < len(passage) and found[stop] == passage[k]:
                    stop, k = stop + 1, k + 1
                done[p, word - at] = stop
                if stop - i >= self.how.words:
                    removed[i:stop] = True


_RESULT = "id long, n_words long, n_removed long, kept string"


def _result(ids: list, n_words: list, removed: list, kept: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def _whole(docs: DataFrame) -> DataFrame:
    """Results of documents that keep all words."""

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 1):
                found = [split_words(t) for t in texts]
                yield _result(batch.column(0).slice(start, len(texts)).to_pylist(), [len(w) for w in found], [0] * len(found), [" ".join(w) for w in found])

    return docs.mapInArrow(run, _RESULT)


def _parts(passages: list[tuple[int, list[str]]], how: Passages) -> list[list[tuple[int, list[str]]]]:
    """The passages of each automaton of a shard."""
    parts, words = [[]], 0
    for doc, found in passages:
        if words > how.automaton_words:
            parts.append([])
            words = 0
        parts[-1].append((doc, found))
        words += len(found)
    return parts


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[int, int]]]:
    """Parts of batches in which the first two columns stay the same."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        for i, j in zip([0, *change], [*change, len(a)], strict=True):
            if j > i:
                yield batch.slice(i, j - i), (int(a[i]), int(b[i]))


def _streamed(docs: DataFrame, passages: DataFrame, how: Passages) -> DataFrame:
    """Results of documents after a pass through the automata of their shard, which get the passages that its documents ask for."""

    def passages_of(rows: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
        for doc, text, low, high in zip(*(rows.column(c).to_pylist() for c in range(2, 6)), strict=True):
            found = text.split(" ")
            for i, j in _runs(low, high, how):
                yield doc, found[i : j + how.words]

    def run(batches):
        shard, held, parts, built = None, [], [], None
        for rows, at in _stretches(batches):
            if at[0] != shard:
                shard, held, built = at[0], [], None
            if not at[1]:
                held += passages_of(rows)
                continue
            if built is None:
                parts = _parts(held, how)
                # One is the rule; where documents ask for more, each slice goes through one after another.
                built = [Automaton(parts[0], how)] if len(parts) == 1 else []
            for start, texts in slices(rows, 3):
                ids = rows.column(2).slice(start, len(texts)).to_pylist()
                found = [split_words(t) for t in texts]
                removed = [np.zeros(len(w), dtype=bool) for w in found]
                for automaton in built or (Automaton(part, how) for part in parts):
                    for doc, own, gone in zip(ids, found, removed, strict=True):
                        automaton.mark(doc, own, gone)
                kept = [" ".join(w for w, gone in zip(own, r.tolist(), strict=True) if not gone) for own, r in zip(found, removed, strict=True)]
                yield _result(ids, [len(w) for w in found], [int(r.sum()) for r in removed], kept)

    # A row that asks for nothing goes to any shard.
    guests = docs.select(F.coalesce("shard", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).alias("shard"), F.lit(1).alias("guest"), F.col("id").alias("doc"), "text", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    home = passages.select("shard", F.lit(0).alias("guest"), F.col("owner").alias("doc"), F.col("words").alias("text"), "low", "high")
    return home.unionByName(guests).repartition("shard").sortWithinPartitions("shard", "guest").mapInArrow(run, _RESULT)


def without_passages(docs: DataFrame, how: Passages | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of docs.

    A word goes if it lies in a window of how.words words that also begins in
    a document with a smaller id; windows are those of the texts as they came.
    A null or empty text, or one without words, has none. Rows that share an
    id don't take words from one another. A row with a null id takes no part:
    it keeps all words, and no other loses any for it. An empty table stays
    empty.
    """
    how = how or Passages()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("id is not null")
    asked = written(asked_windows(known, how), "asked")
    targets = written(asked.where("cut = -1").select(F.col("owner").alias("target"), "shard").distinct(), "targets")
    may = Sieve(targets.select("target"), "target").may_hold(F.col("id"))
    wanted = asked.where("cut >= 0")
    passages = wanted.join(written(_passage_texts(known, wanted, how), "passages"), ["owner", "cut"])
    # What the filter lets through by chance has no shard.
    near = known.where(may).join(targets.hint("merge"), F.col("id") == F.col("target"), "left")
    rest = rows.where("id is null").unionByName(known.where(~may))
    return _streamed(near, passages, how).unionByName(_whole(rest))
