"""Rows of jobs and of schools in profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions import dates as d


def jobs_alone(jobs: DataFrame, schools: DataFrame, now: Column) -> DataFrame:
    """jobs without rows that share their dates with a school of the same person, by the text or by the months.

    Both have person and dates. Each way of being equal is an anti-join of its
    own, so neither is an OR that only a nested loop could join. Rows without
    dates stay; a null person has no schools.
    """
    key, span = d.dates_key(F.col("dates")), d.month_range(F.col("dates"), now)
    marked = jobs.withColumns({"_key": key, "_span": span})
    # As rows of an array, what is missing goes without a filter, for which Spark would work out the dates a second time.
    keys = schools.select("person", F.explode(F.filter(F.array(key), lambda x: x != "")).alias("_key")).distinct()
    spans = schools.select("person", F.explode(F.array_compact(F.array(span))).alias("_span")).distinct()
    return marked.join(keys, ["person", "_key"], "left_anti").join(spans, ["person", "_span"], "left_anti").select(*jobs.columns)
