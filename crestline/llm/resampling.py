"""Importance resampling toward a target: documents drawn by how much likelier their word runs are in the target.

A feature is a run of one to n words, its bucket the CRC-32 of the run. One scan
of a document keeps the running CRC states of the runs that began at the last n
words and extends each by a space and the next word, so no run is ever put
together. Buckets of the corpus and of the target are counted in the tasks; a
bucket's gain is the logarithm of the ratio of its shares. Documents get the
sum of their features' gains and seeded Gumbel noise, and the highest are drawn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.bpe import slices
from crestline.llm.common import written
from crestline.operators.positions import numbered

#: What is no part of a word, as a space: all of ASCII but digits and a to z.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for c in range(256))


@dataclass(frozen=True)
class Resampling:
    """longest: words in a run at most; percent of the documents with at least least_words are drawn."""

    longest: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42
    scan: int = 1 << 16


def words(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="replace").lower().translate(_WORD_BYTES).split()


class CrcRing:
    """Running CRC states of the runs that began at the last words; bounded whatever the text's length."""

    def __init__(self, how: Resampling):
        self.how = how

    def buckets(self, found: list[bytes]) -> Iterator[np.ndarray]:
        """Buckets of all runs of found, a piece of the text at a time."""
        last: list[int | None] = [None] * (self.how.longest - 1)
        for lo in range(0, len(found), self.how.scan):
            piece = found[lo : lo + self.how.scan]
            spaced = [b" " + w for w in piece]
            state: list[int | None] = list(map(crc32, piece))
            out = [state]
            for k, before in enumerate(last):
                # The states of one word ago, each a run that is one word shorter.
                ring = [before, *state[:-1]]
                last[k] = state[-1]
                state = [None if s is None else crc32(w, s) for w, s in zip(spaced, ring, strict=True)]
                out.append(state)
            yield np.array([s for level in out for s in level if s is not None], dtype=np.int64) % self.how.buckets


def bucket_counts(docs: DataFrame, how: Resampling, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows of docs: a task sends one row for each bucket at most."""

    def run(batches):
        ring, counts = CrcRing(how), np.zeros(how.buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in slices(batch, 0):
                for text in texts:
                    for found in ring.buckets(words(text)):
                        counts += np.bincount(found, minlength=how.buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, dtype=np.int64)
    for bucket, n in found.collect():  # how.buckets rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares in target and source)."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variate) of the seed and the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, how: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score of each row of docs."""

    def run(batches):
        ring = CrcRing(how)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in slices(batch, 1):
                rows = []
                for doc_id, text in zip(ids[start:], texts, strict=False):
                    found, n, weight = words(text), 0, 0
                    for piece in ring.buckets(found):
                        n += len(piece)
                        weight += int(gain[piece].sum())
                    rows.append((doc_id, len(found), n, weight, weight + noise(doc_id, how.seed)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, how: Resampling | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank of each row of docs; rank is null for those that aren't drawn.

    target holds the texts to be like, in a column text. floor(percent * N / 100)
    of the N documents with at least least_words are drawn: the highest
    scores, ties to the smaller id, a null id last. A null or empty text has
    no features and weight 0. Rows that share an id get the same noise and are
    drawn each for itself; equal rows are numbered in any order. Empty tables
    count nothing: without a target all buckets have one share there.
    """
    how = how or Resampling()
    gain = gains(bucket_counts(docs, how, text_col), bucket_counts(target, how))
    found = written(scores(docs, gain, how, id_col, text_col), "scores").withColumn("row", F.monotonically_increasing_id())
    eligible = found.where(F.col("n_words") >= how.least_words)
    drawn = how.percent * eligible.count() // 100
    placed = numbered(eligible, F.desc("score"), F.asc_nulls_last("id"), F.col("row"), name="place")
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place", "row")
    rest = found.where(F.col("n_words") < how.least_words).drop("row").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
