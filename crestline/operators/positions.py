"""Places of rows in a total order, range by range: no task sorts or numbers more than its own range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.sources.scratch import stored

#: monotonically_increasing_id() holds the partition above these bits and the row in it below.
_ROW_BITS = 33


def _ranged(rows: DataFrame, order: tuple[Column, ...], name: str) -> DataFrame:
    """rows by ranges of an order, sorted in each and written once with _range and _at, their row in it."""
    at = F.col("_at")
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    return placed.select("*", F.shiftright(at, _ROW_BITS).alias("_range")).withColumn("_at", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))


def _before(placed: DataFrame, total: Column) -> DataFrame:
    """placed with _before, the total of all earlier ranges. One number for each partition comes to the driver and goes out again."""
    before, so_far = [], 0
    for which, n in placed.groupBy("_range").agg(total).orderBy("_range").collect():
        before.append((which, so_far))
        so_far += n
    return placed.join(F.broadcast(placed.sparkSession.createDataFrame(before, "_range long, _before long")), "_range")


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """rows with their place 1, 2, 3, ... in the order given.

    Rows that are equal in all of order share a range and are numbered in any
    order, so end with a column that tells rows apart. An empty table stays
    empty.
    """
    found = _before(_ranged(rows, order, name), F.max("_at") + 1)
    return found.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_at", "_range", "_before")


def running(rows: DataFrame, weight: str, *order: Column, name: str = "before") -> DataFrame:
    """rows with the sum of weight, a column of longs without nulls, over all rows that come before in the order given."""
    found = _before(_ranged(rows, order, name), F.sum(weight))
    here = F.sum(weight).over(W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn(name, F.col("_before") + F.coalesce(here, F.lit(0))).drop("_at", "_range", "_before")
