"""Document quality by hierarchical empirical Bayes.

A logistic model on the shape of a text gives each document's own evidence.
Grouped sums of it over hosts, and over paths within hosts, give Beta
posteriors: a path is shrunk toward its host, a host toward the whole, the more
the less it holds. How much is read off the spread of the groups' means. The
score replaces the global odds that the document's own model implies by those
of its path, its own evidence left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from crestline.llm.bpe import slices
from crestline.llm.common import written
from crestline.llm.learning import labelled_sample

#: What counts as a symbol, as a stop, and which capitals can be told byte by byte.
SYMBOLS, STOPS, CAPITALS, DIGITS, SPACES = b"#$%&*+<=>@[\\]^_`{|}~", b".,;:!?\"'()-", bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c"
FEATURES = 10


@dataclass(frozen=True)
class Quality:
    """sample: labelled documents that the model is fitted on, at most. least: the score from which a document stays.

    weakest and strongest bound the prior counts that the groups' spread gives.
    """

    sample: int = 20_000
    least: float = 0.5
    weakest: float = 2.0
    strongest: float = 1_000.0
    ridge: float = 1e-3


def features(text: str | None) -> list[float]:
    """The shape of a text: shares of kinds of bytes, its words, its repeats and its length."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    share = lambda kinds: (len(raw) - len(raw.translate(None, kinds))) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    return [share(SYMBOLS), share(STOPS), share(CAPITALS), share(DIGITS), share(SPACES), raw.count(b"!!") / n_words, raw.count(b" | ") / n_words, len(set(words)) / n_words, 1 - len(set(lines)) / n_lines, math.log1p(len(words))]


def _expanded(x: np.ndarray) -> np.ndarray:
    """The features, their roots (small shares tell most) and a constant."""
    return np.c_[x, np.sqrt(np.maximum(x, 0)), np.ones(len(x))]


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float) -> np.ndarray:
    """Weights of _expanded features by Newton's method on standardised columns, the constant set back to the true share of label 1."""
    prior = min(max(share, 1e-3), 1 - 1e-3)
    full = _expanded(x) if len(x) else np.zeros((0, 2 * FEATURES + 1))
    out = np.zeros(2 * FEATURES + 1)
    out[-1] = math.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return out
    mean, spread = full.mean(axis=0), full.std(axis=0)
    mean[-1], spread[spread < 1e-12] = 0.0, 1.0
    z = (full - mean) / spread
    w = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], ridge * len(y))
    penalty[-1] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w / spread
    weights[-1] = w[-1] - (w[:-1] * mean[:-1] / spread[:-1]).sum()
    even = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weights[-1] += math.log(prior / (1 - prior)) - math.log(even / (1 - even))
    return weights


def fit(docs: DataFrame, labels: DataFrame, how: Quality, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The document model, from at most how.sample labelled documents, none of them held out."""
    sample, share = labelled_sample(docs, labels, "quality", how.sample, id_col, text_col)

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sorted((r["id"], r["y"], r["x"]) for r in sample.select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>").collect())
    return fit_logistic(np.array([r[2] for r in rows]).reshape(-1, FEATURES), np.array([r[1] for r in rows], dtype=float), share, how.ridge)


def _evidence(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """id, host, path, p: what the text alone says."""

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 3):
                z = _expanded(np.array([features(t) for t in texts])) @ model
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, len(texts)) for k in range(3)] + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "host", "path", "p"])

    return docs.mapInArrow(run, "id long, host string, path string, p double")


def _strength(groups: DataFrame, how: Quality) -> float:
    """Prior count of groups with columns n, s (sum of p) and m (the mean they are shrunk to), by moments.

    The spread of the groups' means about m is what sampling gives, m (1 - m) / n,
    and 1 / (k + 1) of m (1 - m) besides; k is the count. All groups are summed in
    Spark, and three numbers come back.
    """
    row = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)), F.sum(F.col("m") * (1 - F.col("m"))), F.sum(F.col("n") * F.col("m") * (1 - F.col("m")))).first()
    if row[0] is None or not row[2]:
        return how.strongest
    between = (row[0] - row[1]) / row[2]
    return how.strongest if between <= 1 / (how.strongest + 1) else max(how.weakest, 1 / between - 1)


@dataclass(frozen=True)
class Sites:
    """table: host, path, n, s (sum of p), host_n, host_s. overall: the mean of p. k_host, k_path: prior counts."""

    table: DataFrame
    overall: float
    k_host: float
    k_path: float

    def score(self, seen: DataFrame) -> DataFrame:
        """seen, with host, path and p, with p_host, p_path and score of each row beside its other columns."""
        logit = lambda c: F.log(c / (1 - c))
        bounded = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
        # Without the document itself, on either level.
        p_host = (F.col("host_s") - F.col("p") + self.k_host * self.overall) / (F.col("host_n") - 1 + self.k_host)
        p_path = (F.col("s") - F.col("p") + self.k_path * F.col("p_host")) / (F.col("n") - 1 + self.k_path)
        out = seen.join(self.table, ["host", "path"]).withColumn("p_host", bounded(p_host)).withColumn("p_path", bounded(p_path))
        return out.withColumn("score", 1 / (1 + F.exp(-(logit(bounded(F.col("p"))) + logit(F.col("p_path")) - math.log(self.overall / (1 - self.overall))))))


def sites_of(seen: DataFrame, how: Quality) -> Sites:
    """The groups of seen, with host, path and p; summed before the shuffle, so that a hot host is a row of each task."""
    paths = written(seen.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = min(max((s or 0.5) / (n or 1), 1e-6), 1 - 1e-6)
    k_host = _strength(hosts.withColumn("m", F.lit(overall)), how)
    hosts = written(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k_host * overall) / (F.col("n") + k_host)).alias("m")), "hosts")
    sites = paths.join(hosts, "host")
    k_path = _strength(sites, how)
    return Sites(written(sites.select("host", "path", "n", "s", "host_n", "host_s"), "sites"), overall, k_host, k_path)


def score_quality(docs: DataFrame, model: np.ndarray, how: Quality, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_document, p_host, p_path, score, keep of each row of docs.

    host and path name a document's site and its part of it; null is a site of
    its own. A null text counts as empty. Each row counts as one document, also
    if its id is null or repeated. A group's other documents are its evidence
    about a document, so one alone on its path gets its host's mean.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    seen = written(_evidence(rows, model), "evidence")
    out = sites_of(seen, how).score(seen)
    return out.select("id", F.col("p").alias("p_document"), "p_host", "p_path", "score", (F.col("score") >= how.least).alias("keep"))


def without_poor(docs: DataFrame, model: np.ndarray, how: Quality, host: Column, path: Column, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that score_quality would keep. Each row is judged by its own text and site; ids play no part.

    Texts are read twice, for the sites' sums and for the scores, and stay
    where they are as long as the table of sites is one that Spark broadcasts.
    """
    of = [F.coalesce(c.cast("string"), F.lit("")).alias(name) for name, c in (("host", host), ("path", path))]
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            texts = pa.RecordBatch.from_arrays([row.field(at)], names=["text"])
            for start, part in slices(texts, 0):
                z = _expanded(np.array([features(t) for t in part])) @ model
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, len(part)) for k in range(3)] + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["row", "host", "path", "p"])

    sums = _evidence(docs.select(F.lit(None).cast("long").alias("id"), *of, F.col(text_col).cast("string").alias("text")), model)
    sites = sites_of(sums, how)
    # The row goes along as one column, so that none of its names meets one made here.
    rows = docs.select(F.struct("*").alias("row"), *of)
    seen = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("p", DoubleType())]))
    return sites.score(seen).where(F.col("score") >= how.least).select("row.*")
