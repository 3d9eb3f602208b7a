"""How filters overlap: what each would remove in every order, from one count of failure masks.

Each document gets a bit for each filter that it fails. A part's 32 counts by
mask become, by the subset-zeta transform, the survivors of every subset of
filters; a step of an order is the difference between two neighbouring subsets,
and the same holds for counts of labels. Documents are read once, whatever the
number of orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Filter letter to failure, for the filters that look at one text alone."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]", "")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and mask of each row of docs: bit k is set if it fails the k-th filter of ABCDE.

    E fails a row whose text is also that of a row with a smaller id, by a
    SHA-256 of the text. A null text counts as empty, a null part as the empty
    string. A null id is neither smaller nor larger than another: such a row
    passes E, and fails no other row. Rows that share an id don't fail one
    another.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    facts = own.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # The first of a text is aggregated before the shuffle, and a hot text's rows are what Spark splits in the join.
    first = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    return facts.join(first, "digest", "left").select("id", "part", (F.col("mask") + later).alias("mask"))


def survivors(by_mask: np.ndarray) -> np.ndarray:
    """From counts by failure mask (last axis, 2^k long), the number that passes all filters of each subset."""
    subsets = by_mask.copy()
    size = by_mask.shape[-1]
    for bit in range(size.bit_length() - 1):
        with_bit = np.flatnonzero(np.arange(size) >> bit & 1)
        subsets[..., with_bit] += subsets[..., with_bit ^ (1 << bit)]
    # What lies within the complement of a subset has none of its bits.
    return subsets[..., (size - 1) ^ np.arange(size)]


def steps(by_mask: np.ndarray, letters: str = "ABCDE") -> pd.DataFrame:
    """A row for each order of the filters and step, from counts of all, good and toxic documents by mask."""
    left, good, toxic = survivors(by_mask)
    n, whole = len(letters), len(left) - 1
    lost = {(s, k): left[s] - left[s | 1 << k] for s in range(whole + 1) for k in range(n) if not s >> k & 1}
    # Orders in which the filters of s come before k, and those that are left after it.
    shapley = [sum(d * factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for (s, j), d in lost.items() if j == k) for k in range(n)]
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            fails = left[0] - left[1 << k]
            removed = lost[before, k]
            unique = lost[whole ^ 1 << k, k]
            rows.append(("".join(letters[i] for i in order), step, left[after], removed, fails - removed, unique, good[before] - good[after], toxic[before] - toxic[after], shapley[k]))
            before = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order (all 120 of ABCDE) and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    See masks() for nulls and repeats. An id with several rows of labels has
    label 1 if any of them has; a null id or label counts as none. Each row of
    docs counts, also if its id is repeated. A group holds at most 32 rows, one
    for each mask. Without documents there are no parts and no rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("id is not null")
    known = known.groupBy("id").agg(F.max((F.col("q") == 1).cast("long")).alias("good"), F.max((F.col("t") == 1).cast("long")).alias("toxic"))
    found = masks(docs, id_col, text_col, part_col).join(known, "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = found.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        by_mask = np.zeros((3, 32), dtype=np.int64)
        by_mask[:, part["mask"]] = part[["n", "good", "toxic"]].to_numpy().T
        return steps(by_mask).assign(part=part["part"].iloc[0])

    return counts.groupBy("part").applyInPandas(run, SCHEMA)
