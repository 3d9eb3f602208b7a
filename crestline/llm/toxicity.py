"""Toxicity by bags of subwords: their embeddings are averaged into a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams, hashed into buckets, so a spelling
that was never seen shares most of its buckets with one that was. A text's
vector is the mean over the subwords of its distinct words, so saying one thing
again and again changes nothing. The trained model is linear in that
mean, so it comes down to one number for each bucket: a text's log-odds are
the mean of its subwords' numbers, and that is all the executors get.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.bpe import slices
from crestline.llm.common import held_out
from crestline.llm.learning import labelled_sample

WORD = re.compile(r"[^\W_]+")
#: Distinct words that a worker keeps.
KEPT_WORDS = 500_000


@dataclass(frozen=True)
class Subwords:
    """sample: labelled documents that the model is fitted on, at most, each with all of its words. The rest is the model's size and its training."""

    sample: int = 8_000
    buckets: int = 1 << 18
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    steps: int = 200
    batch: int = 256
    rate: float = 1.5
    seed: int = 3


def subwords(word: str, how: Subwords) -> list[int]:
    """Buckets of a word and of its n-grams, with a mark at either end."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in range(how.shortest, how.longest + 1) for i in range(len(marked) - n + 1)}
    return sorted(zlib.crc32(g.encode("utf-8", "surrogatepass")) % how.buckets for g in grams)


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Bags:
    """Texts as the numbers of their distinct words, and the buckets of each word once."""

    def __init__(self, texts: Iterable[Iterable[str]], how: Subwords):
        number: dict[str, int] = {}
        self.words = [np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32) for words in texts]
        buckets = [np.array(subwords(w, how), dtype=np.int32) for w in number]
        self.sizes = np.array([len(b) for b in buckets], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.flat = np.concatenate([np.zeros(0, dtype=np.int32), *buckets])

    def laid_out(self, texts: np.ndarray) -> "Batch":
        """The given texts, each of which has a word."""
        return Batch(self, [self.words[i] for i in texts])


class Batch:
    """Some texts by their words, and each distinct word of them once by its buckets."""

    def __init__(self, bags: Bags, texts: list[np.ndarray]):
        words, self.word_at = np.unique(np.concatenate(texts), return_inverse=True)
        self.lengths = np.array([len(t) for t in texts])
        self.text_starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.sizes = bags.sizes[words]
        ends = np.cumsum(self.sizes)
        self.word_starts = ends - self.sizes
        self.buckets = bags.flat[np.arange(ends[-1]) + np.repeat(bags.starts[words] - self.word_starts, self.sizes)]
        self.n = np.add.reduceat(self.sizes[self.word_at], self.text_starts)

    def mean(self, embed: np.ndarray) -> np.ndarray:
        """For each text the mean over the buckets of its words."""
        by_word = np.add.reduceat(embed[self.buckets], self.word_starts)
        sums = np.add.reduceat(by_word[self.word_at], self.text_starts)
        return (sums.T / self.n).T

    def gradient(self, of_mean: np.ndarray, n_buckets: int) -> np.ndarray:
        """The gradient of the buckets, given that of the texts' means."""
        by_text = of_mean / self.n[:, None]
        out = []
        for part in by_text.T:
            by_word = np.bincount(self.word_at, np.repeat(part, self.lengths), len(self.sizes))
            out.append(np.bincount(self.buckets, np.repeat(by_word, self.sizes), n_buckets))
        return np.stack(out, axis=1)


def train(texts: Iterable[Iterable[str]], labels: np.ndarray, share: float, how: Subwords) -> np.ndarray:
    """For each bucket its part of the log-odds, and last the constant; texts are their distinct words, share is that of label 1 among all labels.

    Embeddings and softmax are trained together by AdaGrad on shuffled batches.
    A fifth of the texts is kept back to set the constant.
    Without both labels there is nothing to tell apart, and the constant is all.
    """
    prior = min(max(share, 1e-3), 1 - 1e-3)
    scores = np.zeros(how.buckets + 1, dtype=np.float64)
    scores[-1] = math.log(prior / (1 - prior))
    if len(set(labels.tolist())) < 2:
        return scores
    bags, rng = Bags(texts, how), np.random.default_rng(how.seed)
    usable = rng.permutation([i for i, words in enumerate(bags.words) if len(words)])
    usable, kept_back = usable[len(usable) // 5 :], usable[: len(usable) // 5]
    batches = np.array_split(usable, max(1, len(usable) // how.batch))
    embed = rng.uniform(-1, 1, (how.buckets, how.dim)) / how.dim
    soft, bias = rng.normal(0, 0.1, (how.dim, 2)), np.zeros(2)
    g_embed, g_soft, g_bias = np.full(how.buckets, 1e-12), np.full((how.dim, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(-(-how.steps // len(batches))):
        for b in rng.permutation(len(batches)):
            batch = bags.laid_out(batches[b])
            mean = batch.mean(embed)
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), labels[batches[b]]] -= 1
            error = p / len(p)
            d_embed = batch.gradient(error @ soft.T, how.buckets)
            touched = np.flatnonzero(d_embed.any(axis=1))
            g_embed[touched] += (d_embed[touched] ** 2).mean(axis=1)
            embed[touched] -= how.rate * d_embed[touched] / np.sqrt(g_embed[touched])[:, None]
            for value, grad, seen in ((soft, mean.T @ error, g_soft), (bias, error.sum(axis=0), g_bias)):
                seen += grad**2
                value -= how.rate * 0.2 * grad / np.sqrt(seen)
    scores[:-1] = embed @ (soft[:, 1] - soft[:, 0])
    odds = np.zeros(len(kept_back))
    for lo in range(0, len(kept_back), how.batch):
        odds[lo : lo + how.batch] = bags.laid_out(kept_back[lo : lo + how.batch]).mean(scores)
    scores[-1] = balanced_constant(odds, labels[kept_back], share) if len(set(labels[kept_back].tolist())) == 2 else bias[1] - bias[0]
    return scores


def balanced_constant(odds: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The constant at which as many texts are wrongly flagged as missed, if share of all have label 1."""
    order = np.argsort(-odds, kind="stable")
    weight = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum())[order]
    wrong = np.cumsum(weight * (labels[order] == 0))
    missed = share - np.cumsum(weight * (labels[order] == 1))
    last = int(np.argmax(wrong >= missed))  # flags the texts up to here
    following = odds[order][min(last + 1, len(order) - 1)]
    return -(odds[order][last] + following) / 2


class Scorer:
    """Scores texts with a trained model; keeps the sum and the number of subwords of each distinct word."""

    def __init__(self, scores: np.ndarray, how: Subwords):
        self.scores, self.how = scores, how
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        if len(self.number) > KEPT_WORDS:
            self.forget()
        new = [w for w in words if w not in self.number]
        buckets = [subwords(w, self.how) for w in new]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        if new:
            sizes = np.array([len(b) for b in buckets])
            flat = np.fromiter((x for b in buckets for x in b), dtype=np.int64, count=int(sizes.sum()))
            self.sums = np.r_[self.sums, np.add.reduceat(self.scores[flat], np.r_[0, np.cumsum(sizes)[:-1]])]
            self.counts = np.r_[self.counts, sizes]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        words = [distinct_words(t) for t in texts]
        self.learn(list(set().union(*words)))
        out = np.empty(len(texts))
        for i, ws in enumerate(words):
            at = np.fromiter(map(self.number.__getitem__, ws), dtype=np.int64, count=len(ws))
            out[i] = self.scores[-1] + (self.sums[at].sum() / self.counts[at].sum() if len(at) else 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, how: Subwords, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The trained model; it learns from at most how.sample labelled documents, none of them held out.

    Executors turn the texts into their distinct words; what the driver gets is
    bounded in documents.
    """
    sample, share = labelled_sample(docs, labels, "toxic", how.sample, id_col, text_col)

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 2):
                words = [sorted(distinct_words(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, len(texts)) for k in (0, 1, 3)] + [pa.array(words, pa.list_(pa.string()))], names=["id", "y", "row", "words"])

    rows = sample.select("id", "y", "text", "row").mapInArrow(run, "id long, y int, row long, words array<string>").toArrow().sort_by([("id", "ascending"), ("row", "ascending")])
    y = rows.column("y").to_numpy().astype(np.int64)
    return train((words.as_py() for words in rows.column("words")), y, share, how)


def score_toxicity(docs: DataFrame, model: np.ndarray, how: Subwords, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 from 0.5 on) of each row of docs.

    The whole text counts. A null or empty text, or one without words, gets
    the model's constant. A row with a null id is scored too and counts as not
    held out. Rows stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(batches):
        scorer = Scorer(shared.value.astype(np.float64), how)
        for batch in batches:
            for start, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(scorer.probabilities(texts))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")
    return rows.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: np.ndarray, how: Subwords, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that score below 0.5. Each row is judged by its own text; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value.astype(np.float64), how)
        for batch in batches:
            for start, texts in slices(batch, at):
                yield batch.slice(start, len(texts)).filter(pa.array(scorer.probabilities(texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)
