"""Near-duplicate documents by MinHash.

Shingle sets are hashed to 64 bits; many universal hashes keep the smallest
value each, and bands of minima put similar sets into common buckets. Texts
with the same shingle set are one class from then on, so copies cost nothing
more. Inside a bucket, documents whose signatures agree often enough become
candidate clusters; inside a cluster, full sets confirm each link. Both steps
ask only which documents hang together, so a document that is already joined
is not compared with its own group again and no list of pairs is ever made.
Large buckets and clusters are dealt out as pairs of bounded blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.blocks import bounded_groups, dealt
from crestline.llm.bpe import slices
from crestline.llm.common import written
from crestline.llm.components import connected_components
from crestline.llm.membership import Sieve


@dataclass(frozen=True)
class MinHash:
    """words: shingle length; percent: 100 times the least similarity; bands of rows minima.

    With the defaults a pair at similarity 0.85 shares no band with a chance
    of 2e-8, one at 0.8 of 3e-6. margin is how far below the least similarity
    two signatures may agree and still be confirmed on full sets: five
    standard deviations at 96 minima. block bounds the documents that a task
    compares at once, and block_shingles about what their full sets hold.
    """

    words: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 4
    margin: float = 0.2
    block: int = 1024
    block_shingles: int = 4_000_000
    seed: int = 20240131

    @property
    def n(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        return int((self.percent / 100 - self.margin) * self.n)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; a shorter text is one shingle, no words are none."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six white-space characters
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - k + 1)
    mixed = np.full(n, min(k, len(words)), dtype=np.uint64)
    for i in range(min(k, len(words))):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique(mixed)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Universal hashes h(x) = (a x + b mod 2^64) >> 32, with odd a, of 64-bit shingles."""

    def __init__(self, how: MinHash):
        rng = np.random.default_rng(how.seed)
        self.how = how
        self.a = rng.integers(0, 2**63, how.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, how.n, dtype=np.uint64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima for each set, none of them empty."""
        flat = np.concatenate(sets)
        starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
        out = np.empty((len(sets), self.how.n), dtype=np.uint32)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, i] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), starts)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit bucket key for each band."""
        keys = np.empty((len(minima), self.how.bands), dtype=np.uint64)
        for band in range(self.how.bands):
            key = np.full(len(minima), band + 1, dtype=np.uint64)
            for i in range(band * self.how.rows, (band + 1) * self.how.rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, i])
            keys[:, band] = key
        return keys.view(np.int64)


def sketches(docs: DataFrame, how: MinHash) -> DataFrame:
    """id, n_shingles, digest (of the set), keys (bucket of each band), marks (the low byte of each minimum)."""

    def run(batches):
        sketcher = Sketcher(how)
        for batch in batches:
            for start, texts in slices(batch, 1):
                sets = [shingles(t, how.words) for t in texts]
                some = [i for i, s in enumerate(sets) if len(s)]
                digest, keys, marks = [[None] * len(texts) for _ in range(3)]
                if some:
                    minima = sketcher.minima([sets[i] for i in some])
                    for i, k, m in zip(some, sketcher.band_keys(minima), minima.astype(np.uint8), strict=True):
                        digest[i], keys[i], marks[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k, m.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["id", "n_shingles", "digest", "keys", "marks"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary, keys array<long>, marks binary")


class Groups:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up


def hang_together(n: int, linked: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray) -> np.ndarray:
    """The root of each of n items by links.

    linked(i, others) says which of the others i is linked with. side holds 0
    and 1 where only pairs across are asked for (two blocks), else -1. An item
    is compared only with items of other groups, so a group of copies costs
    one comparison each.
    """
    groups = Groups(n)
    for i in range(n):
        others = np.arange(i + 1, n)
        others = others[(side[i] < 0) | (side[others] != side[i])]
        others = others[groups.roots()[others] != groups.root(i)]
        if len(others):
            for j in others[linked(i, others)]:
                groups.join(i, int(j))
    return groups.roots()


def _stars(groups: DataFrame, key: str, value: str, links: Callable[[np.ndarray, list, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): a row's id and the smallest id that it hangs together with in its group of key, p and q."""

    def run(batches):
        for rows, starts in bounded_groups(batches, 3):
            ids, values = rows.column(4).to_numpy(), rows.column(5).to_pylist()
            p, q, mine = (rows.column(k).to_numpy() for k in (1, 2, 3))
            a, b = [], []
            for i, j in zip(starts, [*starts[1:], len(ids)], strict=True):
                if j - i > 1:
                    # Within one block all pairs count, of two blocks only those across: the others are a pair of their own.
                    side = np.full(j - i, -1) if p[i] == q[i] else (mine[i:j] == q[i]).astype(int)
                    root = links(ids[i:j], values[i:j], side)
                    own = np.flatnonzero(root != np.arange(j - i))
                    a.append(ids[i:j][own])
                    b.append(ids[i:j][root[own]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    columns = groups.select(key, "p", "q", "mine", "id", value)
    return columns.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "id").mapInArrow(run, "a long, b long")


def _marks_links(how: MinHash) -> Callable[[np.ndarray, list, np.ndarray], np.ndarray]:
    def links(ids: np.ndarray, values: list, side: np.ndarray) -> np.ndarray:
        marks = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(ids), how.n)
        return hang_together(len(ids), lambda i, others: (marks[others] == marks[i]).sum(axis=1) >= how.least_agreeing, side)

    return links


def _set_links(how: MinHash) -> Callable[[np.ndarray, list, np.ndarray], np.ndarray]:
    def links(ids: np.ndarray, values: list, side: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(s, dtype=np.uint64) for s in values]
        sizes = np.array([len(s) for s in sets])
        ends = np.r_[0, np.cumsum(sizes)]
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        has = np.zeros(len(distinct), dtype=bool)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            out = np.zeros(len(others), dtype=bool)
            # Sizes alone rule out most: the intersection is at most the smaller set, the union at least the larger.
            near = 100 * np.minimum(sizes[others], sizes[i]) >= how.percent * np.maximum(sizes[others], sizes[i])
            at = others[near]
            if len(at):
                has[code[ends[i] : ends[i + 1]]] = True
                if len(at) > 64:
                    before = np.r_[0, np.cumsum(has[code])]
                    both = before[ends[at + 1]] - before[ends[at]]
                else:
                    both = np.array([np.count_nonzero(has[code[ends[j] : ends[j + 1]]]) for j in at])
                has[code[ends[i] : ends[i + 1]]] = False
                out[near] = 100 * both >= how.percent * (sizes[at] + sizes[i] - both)
            return out

        return hang_together(len(ids), linked, side)

    return links


def _candidate_sets(docs: DataFrame, clusters: DataFrame, how: MinHash) -> DataFrame:
    """id, cluster, n (the cluster's size) and shingles of the documents in clusters.

    Texts are what the join shuffles: they compress well, and hashes do not. A
    Bloom filter of the clusters' ids keeps the other texts out of the shuffle.
    """

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 3):
                sets = pa.array([shingles(t, how.words).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(texts)) for k in range(3)), sets], names=["id", "cluster", "n", "shingles"])

    # A merge at every size: what the shuffle carries grows in proportion.
    near = docs.where(Sieve(clusters.select("id"), "id").may_hold(F.col("id"))).join(clusters.hint("merge"), "id")
    return near.select("id", "cluster", "n", "text").mapInArrow(run, "id long, cluster long, n long, shingles binary")


def near_duplicates(docs: DataFrame, how: MinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs.

    Two documents are linked if their shingle sets are at least how.percent
    hundredths alike, confirmed on full sets. component_id is the smallest id
    that links reach, and kept says whether that is the row's own. A null or
    empty text, or one without words, has an empty set and links with
    nothing. A row with a null id links with nothing either; its component_id
    is null and it is kept. Rows that share an id are one document, with the
    links of all its texts.
    """
    how = how or MinHash()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(sketches(rows, how), "sketches")
    linkable = sketch.where("id is not null and digest is not null")
    # The one shuffle of keys and marks; copies are dropped before it.
    classes = written(linkable.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("n_shingles").alias("n_shingles")), "classes")
    in_bands = classes.select("id", F.explode("keys").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = dealt(in_bands.join(buckets, "key"), "n", how.block).join(classes.select("id", "marks"), "id")
    clusters = connected_components(_stars(shared, "key", "marks", _marks_links(how)))
    clusters = written(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    # A cluster of long documents counts as one of more: its blocks are bounded by what they hold.
    long = F.ceil(F.sum("n_shingles") * how.block / how.block_shingles)
    sizes = written(clusters.join(classes.select("id", "n_shingles"), "id").groupBy("cluster").agg(F.greatest(F.count("*"), long).cast("long").alias("n")), "sizes")
    # Only documents with a candidate bring their full sets.
    sets = _candidate_sets(rows, written(clusters.join(sizes, "cluster"), "members"), how)
    confirmed = _stars(dealt(sets, "n", how.block), "cluster", "shingles", _set_links(how))
    # An id with several texts links their classes.
    several = linkable.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("one"), F.max(F.xxhash64("digest")).alias("other")).where("one <> other").select("id")
    of_class = linkable.join(several, "id", "left_semi").join(classes.select("digest", F.col("id").alias("rep")), "digest").select("id", "rep")
    least = of_class.groupBy("id").agg(F.min("rep").alias("b"))
    twins = of_class.join(least, "id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    components = connected_components(confirmed.unionByName(twins)).withColumnRenamed("node", "id")
    named = classes.select("digest", "id").join(components, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id")).cast("long")
    return sketch.join(named, "digest", "left").select("id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
