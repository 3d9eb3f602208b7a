"""Vector retrieval, vocabularies and n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cosine_top_k(vectors: DataFrame, query_every: int, k: int, block: int = 8_192, at_once: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other vectors for each whose id query_every divides.

    Queries meet vectors in blocks of bounded size, and each block gives its k
    best. The score is the cosine to four digits, ties go to the smaller id.
    Vectors that are null, empty or hold a null or NaN component take no part,
    and only vectors of equal length are compared.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("v") > 0)
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & sound)
    asked = v.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    blocks, turns = max(1, -(-v.count() // block)), max(1, -(-asked.count() // at_once))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one_of = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    left = v.select("vec_id", "v", F.size("v").alias("dim"), one_of(blocks).alias("block"), every(turns).alias("turn"))
    right = asked.select("vec_id", "v", F.size("v").alias("dim"), every(blocks).alias("block"), one_of(turns).alias("turn"))

    def best(key, corpus: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(corpus) and len(queries):
            corpus = corpus.sort_values("vec_id", ignore_index=True)
            a, q = np.stack(corpus["v"]), np.stack(queries["v"])
            scores = np.round(q @ a.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(a, axis=1) + 1e-12), 4)
            scores[queries["vec_id"].to_numpy()[:, None] == corpus["vec_id"].to_numpy()] = -np.inf
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found = {"query_id": np.repeat(queries["vec_id"].to_numpy(), at.shape[1]), "vec_id": corpus["vec_id"].to_numpy()[at].ravel(), "score": np.take_along_axis(scores, at, axis=1).ravel()}
        return pd.DataFrame(found)

    keys = ["dim", "block", "turn"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double").where("score > -2")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vocabulary(docs: DataFrame, min_df: int, top: int) -> DataFrame:
    """Words by the number of texts that hold them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq")).where(F.col("doc_freq") >= min_df)
    return counts.orderBy(F.desc("doc_freq"), "word").limit(top)


def known_words(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """id, words: of each text the first words, by the alphabet, that are known, each once; none gives an empty array.

    known is a vocabulary with a row for each word, so a text gathers no more
    than it holds.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,}"), F.lit(0)))
    found = docs.select("id", F.explode(words).alias("word")).join(known.select("word"), "word", "left_semi").groupBy("id").agg(F.slice(F.array_sort(F.collect_set("word")), 1, most).alias("words"))
    return docs.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def common_ngrams(docs: DataFrame, tops: dict[int, int]) -> DataFrame:
    """The most frequent n-grams of each length n."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))
    out = None
    for n, top in tops.items():
        # Places become rows and then words: a list is cut once, and no list of its n-grams is made. Neither is it filtered, which would cut it again.
        places = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
        gram = F.concat_ws(" ", *[F.get("words", F.col("i") + j) for j in range(n)])
        counts = docs.select(words.alias("words")).select("words", F.explode(places).alias("i")).groupBy(gram.alias("ngram")).agg(F.count(F.lit(1)).alias("freq"))
        part = counts.orderBy(F.desc("freq"), "ngram").limit(top).select(F.lit(n).alias("n"), "ngram", "freq")
        out = part if out is None else out.unionByName(part)
    return out
