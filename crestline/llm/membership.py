"""Which rows may have a key of a given set: a Bloom filter that keeps the others out of a shuffle.

The filter has a fixed number of bits for each key, counted beforehand, and is
put together in Spark; only its words come to the driver. It never denies a key
of the set, so an exact join behind it gives what the join alone would give. A
set that would need more than most_bits gets none: then the join takes all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
PROBES = 5


class Sieve:
    """may_hold(column) is false only for values that keys, a column of distinct longs, does not hold."""

    def __init__(self, keys: DataFrame, key: str, most_bits: int = 1 << 27):
        n = keys.count()
        self.bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
        self.words = None
        if self.bits > most_bits:
            return
        at = F.explode(F.array(*[self._place(F.col(key), i) for i in range(PROBES)]))
        masks = keys.select(at.alias("at")).select((F.col("at") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mask"))
        found = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(self.bits // 64, dtype=np.int64)
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy()
        self.words = keys.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def _place(self, key: Column, i: int) -> Column:
        first, step = (F.pmod(F.xxhash64(key, F.lit(k)), F.lit(self.bits)) for k in (101, 102))
        return F.pmod(first + i * step, F.lit(self.bits))

    def may_hold(self, key: Column) -> Column:
        if self.words is None:
            return F.lit(True)
        shared, bits = self.words, np.int64(self.bits)

        @F.pandas_udf("boolean")
        def held(first: pd.Series, step: pd.Series) -> pd.Series:
            words, out = shared.value, np.ones(len(first), dtype=bool)
            at, step = first.to_numpy(np.int64), step.to_numpy(np.int64)
            for i in range(PROBES):
                place = (at + i * step) % bits
                out &= (words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            return pd.Series(out)

        return held(self._place(key, 0), F.pmod(F.xxhash64(key, F.lit(102)), F.lit(self.bits)))


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """rows but those whose key, a long, is in dropped, a written table of that one column. Rows that the filter clears are not shuffled."""
    may = Sieve(dropped, key).may_hold(F.col(key))
    return rows.where(~may).unionByName(rows.where(may).join(dropped.hint("merge"), key, "left_anti"))
