"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are dealt into blocks, and queries stream past each block's index. It
holds, for each quantised impact (the power of two above a component's size)
and component, the postings (rows, values) of that impact. Queries take the
segments from the highest impact down and add them to their accumulators. What
a row may still gain is bounded by the length of what it has left times that of
the query; a query stops only when this proves that few rows can be members,
and those are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crestline.llm.blocks import meetings
from crestline.llm.common import written

#: Components up to this make sums of up to 2^22 products that 64 bits hold exactly; vectors beyond it are scored in Python's integers.
MOST = 1 << 20
LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1


def floored(x: float, scale: int) -> int:
    """floor(scale * x), exactly also where the product overflows."""
    product = scale * x
    return math.floor(product) if math.isfinite(product) else scale * int(x)


def quantised(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, v (components floor(scale * x) as 32-bit integers) of the rows that take part; wide ones keep v as doubles, not yet scaled."""

    def run(batches):
        for batch in batches:
            ids, dims, out, wide = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not x or None in x:
                    continue
                v = np.array(x, dtype="<f8")
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        scaled = np.floor(scale * v)
                    wide.append(bool(np.abs(scaled).max() > MOST))
                    ids.append(i)
                    dims.append(len(v))
                    out.append((v if wide[-1] else scaled.astype("<i4")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_()), pa.array(out, pa.binary())], names=["id", "dim", "wide", "v"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(run, "id long, dim int, wide boolean, v binary")


class ImpactIndex:
    """The postings of one block of vectors by impact and component, and the length that each vector has left below an impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        impact = np.frexp(size)[1]  # 0 for 0, else the power of two above
        #: (impact, [(component, rows, values)]), the highest first; what is 0 has no posting.
        self.segments: list[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]] = []
        self.left: dict[int, np.ndarray] = {}
        for level in np.unique(impact)[::-1]:
            if level > 0:
                here = impact == level
                postings = [(d, rows, vectors[rows, d][:, None]) for d in np.flatnonzero(here.any(axis=0)) if len(rows := np.flatnonzero(here[:, d]))]
                self.segments.append((int(level), postings))
                self.left[int(level)] = np.sqrt((np.where(impact < level, size, 0).astype(float) ** 2).sum(axis=1))

    def top(self, queries: np.ndarray, own: list[tuple[int, int]], k: int, few: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of each query's k best rows, ties to the smaller row; own[i] is the range of rows that query i leaves out."""
        n = len(self.vectors)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2] * len(queries)
        active = np.arange(len(queries))
        gained = np.zeros((n, len(queries)), dtype=np.int64)
        length = np.linalg.norm(queries.astype(float), axis=1)
        for level, postings in [*self.segments, (0, [])]:
            for d, rows, values in postings:
                gained[rows] += values * queries[active, d]
            # The last segment leaves nothing; a bound in doubles is widened by what these may be off by.
            slack = self.left[level][:, None] * length[active] * (1 + 1e-9) + 1e-6 if level else 0
            least, most = gained - slack, gained + slack  # of rows beside the query's own, which are left out at the end
            for a, q in enumerate(active):
                lo, hi = own[q]
                if hi > lo:
                    least[lo:hi, a] = -MOST_SCORE if not level else -np.inf
            kth = np.partition(least, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
            possible = most >= kth
            done = possible.sum(axis=0) <= np.maximum(few, k) if level else np.ones(len(active), dtype=bool)
            for a in np.flatnonzero(done):
                lo, hi = own[active[a]]
                members = np.flatnonzero(possible[:, a])
                members = members[(members < lo) | (members >= hi)]
                scores = self.vectors[members] @ queries[active[a]]
                best = np.lexsort((members, -scores))[:k]
                found[active[a]] = members[best], scores[best]
            active, gained = active[~done], gained[:, ~done]
            if not len(active):
                break
        return found


class CorpusBlock:
    """One block of candidates: the index of those that fit it, and the others by themselves."""

    def __init__(self, rows: pa.RecordBatch, scale: int):
        self.scale = scale
        ids, wide = rows.column(4).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False)
        order = np.argsort(ids[~wide], kind="stable")
        raw = rows.column(6).to_pylist()
        self.ids = ids[~wide][order]
        narrow = [raw[i] for i in np.flatnonzero(~wide)[order]]
        self.index = ImpactIndex(np.stack([np.frombuffer(v, dtype="<i4") for v in narrow]).astype(np.int64)) if narrow else None
        self.others = [(int(ids[i]), self.whole(raw[i])) for i in np.flatnonzero(wide)]

    def whole(self, raw: bytes) -> list[int]:
        return [floored(x, self.scale) for x in np.frombuffer(raw, dtype="<f8").tolist()]

    @staticmethod
    def exact(a: list[int], b: list[int]) -> int:
        return min(MOST_SCORE, max(LEAST_SCORE, sum(x * y for x, y in zip(a, b, strict=True))))

    def answers(self, rows: pa.RecordBatch, k: int, few: int) -> Iterator[tuple[int, int, int]]:
        """(query id, vector id, score) of the k best of this block for each query."""
        ids, wide, raw = rows.column(4).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False), rows.column(6).to_pylist()
        at = np.flatnonzero(~wide)
        if len(at) and self.index:
            queries = np.stack([np.frombuffer(raw[i], dtype="<i4") for i in at]).astype(np.int64)
            own = list(zip(np.searchsorted(self.ids, ids[at], "left"), np.searchsorted(self.ids, ids[at], "right"), strict=True))
            for i, (members, scores) in zip(at, self.index.top(queries, own, k, few), strict=True):
                yield from ((int(ids[i]), int(self.ids[m]), int(s)) for m, s in zip(members, scores, strict=True))
        for i, is_wide in enumerate(wide):
            if is_wide or self.others:
                query = self.whole(raw[i]) if is_wide else np.frombuffer(raw[i], dtype="<i4").tolist()
                yield from ((int(ids[i]), other, self.exact(query, v)) for other, v in self.others if other != ids[i])
                if is_wide and self.index:
                    yield from ((int(ids[i]), int(other), self.exact(query, v.tolist())) for other, v in zip(self.ids, self.index.vectors, strict=True) if other != ids[i])


def top_k(rows: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, block: int = 4096, queries_at_once: int = 65_536, few: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query, a row whose id query_every divides.

    The score is the inner product of floor(scale * x). Candidates are all
    rows of the query's length but those with its own id; ties go to the
    smaller id. Rows with a null id, or a vector that is null, empty or holds
    a null or non-finite component, take no part. A query id that occurs
    again is asked once, with the least of its vectors. Components of any size
    count exactly; a score that 64 bits don't hold is given, and ranks, as the
    nearest number that they hold. No row is left out for its score before the
    stop is proved, so the result is that of comparing everything.
    """
    vectors = written(quantised(rows, scale, id_col, vector_col), "quantised")
    asked = vectors.where(F.pmod("id", F.lit(query_every)) == 0).groupBy("id").agg(F.min(F.struct("dim", "wide", "v")).alias("one")).select("id", "one.*")
    n, n_asked = vectors.count(), asked.count()
    blocks, turns = max(1, -(-n // block)), max(1, -(-n_asked // queries_at_once))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one_of = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    # Each block meets each turn of queries once: queries are copied for the blocks, and the corpus for the few turns.
    left = vectors.select("dim", one_of(blocks).alias("block"), every(turns).alias("turn"), F.lit(0).alias("guest"), "id", "wide", "v")
    right = asked.select("dim", every(blocks).alias("block"), one_of(turns).alias("turn"), F.lit(1).alias("guest"), "id", "wide", "v")
    dealt = left.unionByName(right)

    def run(batches):
        corpus = None
        for what, batch in meetings(batches, 3, 3, 256):
            if what == "open":
                corpus = CorpusBlock(batch, scale)
            elif what == "guests" and (found := list(corpus.answers(batch, k, few))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    each = dealt.repartition(max(1, min(blocks * turns, 8_192)), "dim", "block", "turn").sortWithinPartitions("dim", "block", "turn", "guest")
    found = each.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
