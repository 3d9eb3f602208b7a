"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two symbols that stand side by side inside some token of
the vocabulary. Where two neighbouring bytes of a word never do, a cut is
certain: the parts on either side are encoded by themselves and the ids put one
after the other. Words, and the fragments that the cuts leave, are therefore
independent of the text around them; a task encodes each distinct one once, all
new ones of a batch together in numpy, and keeps them for its later batches.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte alphabet of byte-level vocabularies prints these ranges as themselves.
PRINTED = (range(33, 127), range(161, 173), range(174, 256))
#: Fixed value: the white space that the vocabulary file's \\s stands for.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: str.split() would also split at these.
CONTROLS = re.compile(r"[\x1c-\x1f]")
#: Certain cuts that need no vocabulary: a stop or comma between a letter and white space.
STOPS = re.compile(r"(?<=[A-Za-z])([.,])(?=\s)")
NO_MERGE = np.iinfo(np.int64).max
#: Fragments longer than this are merged one by one with a heap.
LONG_FRAGMENT = 96
#: Distinct chunks that a worker keeps, and the words in them; about 150 MB.
KEPT_CHUNKS = 500_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    own = {b for r in PRINTED for b in r}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary file of the tokenizers library (lower case, white space dropped)."""

    def __init__(self, file: bytes):
        data = json.loads(file)
        model, self.end = data["model"], data["model"]["end_of_word_suffix"]
        vocab, chars = model["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.tokens) + 1
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Base symbol 0..255: a byte; 256..511: a byte that ends its word.
        self.base = np.array([vocab[c] for c in chars] + [vocab[c + self.end] for c in chars], dtype=np.int64)
        first, last = np.full(self.size, -1), np.full(self.size, -1)
        first[self.base] = last[self.base] = np.arange(512)
        #: joins[x, y]: base symbols x and y stand side by side inside some token.
        self.joins = np.zeros((512, 512), dtype=bool)
        merges: dict[int, tuple[int, int]] = {}
        for rank, (x, y) in enumerate(model["merges"]):
            i, j, new = vocab[x], vocab[y], vocab[x + y]
            self.joins[last[i], first[j]] = True
            first[new], last[new] = first[i], last[j]
            merges.setdefault(i * self.size + j, (rank, new))
        self.merges = merges
        self.pairs = np.array(sorted(merges), dtype=np.int64)
        self.ranks = np.array([merges[k][0] for k in self.pairs.tolist()], dtype=np.int64)
        self.made = np.array([merges[k][1] for k in self.pairs.tolist()], dtype=np.int64)
        self.kept: dict[str, bytes] = {}
        self.words_kept: dict[str, bytes] = {}

    def pre_tokens(self, chunk: str) -> list[str]:
        """The words of a piece of text without white space, as they are merged."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # each character for itself: no final sigma
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The merges of one fragment, the lowest rank first and from the left."""
        ids, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n and (found := self.merges.get(ids[i] * self.size + ids[after[i]])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            if ids[i] != x or (j := after[i]) >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x * self.size + y][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def rank_pairs(self, ids: np.ndarray, fragment: np.ndarray, where: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Sets, at the positions where, the rank of the pair that begins there and its place in pairs."""
        rank[where] = NO_MERGE
        inside = where[where + 1 < len(ids)]
        inside = inside[fragment[inside] == fragment[inside + 1]]
        key = ids[inside] * self.size + ids[inside + 1]
        found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[found] == key
        inside, found = inside[hit], found[hit]
        rank[inside], at[inside] = self.ranks[found], found

    def merge_fragments(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All fragments at once: a round merges in each the leftmost pair of its lowest rank.

        ids are the symbols of all fragments in order, fragment the number of
        each symbol's fragment, not falling. Gives the same two after all merges.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.bincount(fragment) if len(fragment) else np.zeros(0, dtype=int)
        for f in np.flatnonzero(sizes > LONG_FRAGMENT):
            at = slice(*np.searchsorted(fragment, [f, f + 1]))
            out = np.array(self.merge_long(ids[at].tolist()), dtype=np.int64)
            done.append((out, np.full(len(out), f)))
        if done:
            short = sizes[fragment] <= LONG_FRAGMENT
            ids, fragment = ids[short], fragment[short]
        rank, at = np.full(len(ids), NO_MERGE), np.zeros(len(ids), dtype=np.int64)
        stale = np.arange(len(ids))
        while len(ids):
            self.rank_pairs(ids, fragment, stale, rank, at)
            begins = np.r_[True, fragment[1:] != fragment[:-1]]
            starts = np.flatnonzero(begins)
            least = np.minimum.reduceat(rank, starts)[np.cumsum(begins) - 1]
            over = least == NO_MERGE
            if over.any():
                done.append((ids[over], fragment[over]))
            best = np.flatnonzero((rank == least) & ~over)
            best = best[np.r_[True, fragment[best[1:]] != fragment[best[:-1]]]] if len(best) else best
            ids[best] = self.made[at[best]]
            keep, changed = ~over, np.zeros(len(ids), dtype=bool)
            keep[best + 1] = False
            changed[best] = changed[np.maximum(best - 1, 0)] = True
            ids, fragment, rank, at = ids[keep], fragment[keep], rank[keep], at[keep]
            stale = np.flatnonzero(changed[keep])
        if not done:
            return ids, fragment
        out, of = np.concatenate([x for x, _ in done]), np.concatenate([f for _, f in done])
        order = np.argsort(of, kind="stable")
        return out[order], of[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, none of them empty, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbol = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbol[ends - 1] += 256
        starts_word = np.zeros(len(symbol), dtype=bool)
        starts_word[ends - sizes] = True
        cut = starts_word.copy()
        cut[1:] |= ~self.joins[symbol[:-1], symbol[1:]]
        fragment = np.cumsum(cut) - 1
        word_of_fragment = (np.cumsum(starts_word) - 1)[cut]
        ids, of = self.merge_fragments(self.base[symbol], fragment)
        counts = np.bincount(word_of_fragment[of], minlength=len(words))
        data, at = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [data[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes chunks that aren't known yet."""
        new = list(chunks)
        parts = [self.pre_tokens(c) for c in new]
        known = {w: self.words_kept[w] for p in parts for w in p if w in self.words_kept}
        words = list({w for p in parts for w in p if w not in known})
        known.update(zip(words, self.encode_words(words), strict=True))
        self.words_kept.update(known)
        self.kept.update([(c, known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p])) for c, p in zip(new, parts, strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is an empty one."""
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
            self.words_kept.clear()
        # A chunk without white space that holds a special token's text was split there, so the whole one is the token.
        self.kept.update((s, i.to_bytes(4, "little")) for s, i in self.special.items())
        cut = [self.chunks(t or "") for t in texts]
        found = [list(map(self.kept.get, chunks)) for chunks in cut]
        gaps = [[i for i, x in enumerate(row) if x is None] if None in row else [] for row in found]
        self.learn({chunks[i] for chunks, gap in zip(cut, gaps, strict=True) for i in gap})
        for chunks, row, gap in zip(cut, found, gaps, strict=True):
            for i in gap:
                row[i] = self.kept[chunks[i]]
        return [b"".join(row) for row in found]

    def chunks(self, text: str) -> list[str]:
        """The text's special tokens and the parts between white space; a stop or comma after a letter is a word of its own."""
        if any(s in text for s in self.special):
            return [c for p in self.splits.split(text) for c in ([p] if p in self.special else self.plain_chunks(p))]
        return self.plain_chunks(text)

    def plain_chunks(self, text: str) -> list[str]:
        if CONTROLS.search(text):
            return [c for c in SPACE.split(text) if c]
        return STOPS.sub(r" \1", text).split()

    def decode(self, ids: bytes) -> str:
        """The tokens of ids, a space between them, as the vocabulary file has no decoder; unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in tokens])


@lru_cache(maxsize=2)
def _loaded(file: bytes) -> WordBpe:
    return WordBpe(file)


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and sent to the executors: a file of fixed size, not of the data's."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def of_task(shared) -> WordBpe:
    """The tokenizer of this worker; the file is parsed once."""
    return _loaded(shared.value)


def slices(batch: pa.RecordBatch, column: int, most_chars: int = 4_000_000):
    """Runs of rows (from, texts) of a batch whose texts have about so many characters together."""
    start, texts, chars = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        text = x.as_py()
        texts.append(text)
        chars += len(text or "")
        if chars >= most_chars:
            yield start, texts
            start, texts, chars = i + 1, [], 0
    if texts:
        yield start, texts


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id, ids (array<int>), n_tokens, ids_sha256, decoded (string), decoded_sha256 of each row of docs.

    Rows stay where they are; nothing is shuffled. A null text counts as empty:
    no ids, the digests of nothing. Null and repeated ids are kept as they
    are, and other columns of docs play no part. keep_ids=False leaves ids and
    decoded null, for callers that want the digests alone.
    """
    import hashlib

    shared = vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = of_task(shared)
        for batch in batches:
            for start, texts in slices(batch, 1):
                coded = bpe.encode(texts)
                ids = [np.frombuffer(c, dtype="<u4").astype(np.int32) if keep_ids else None for c in coded]
                n, sha, text, text_sha = [], [], [], []
                for c in coded:
                    back = bpe.decode(c)
                    n.append(len(c) // 4)
                    sha.append(hashlib.sha256(c).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    text.append(back if keep_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(sha), pa.array(text, pa.string()), pa.array(text_sha)],
                    names=["id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string")
