"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """df dealt out over all cores if its files are fewer than these and hold at most most_bytes, else df as it is.

    A file of one row group is read by one task, and so is all that follows
    without a shuffle. Larger tables have row groups enough and are not shuffled.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    held = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(cores) if held <= most_bytes else df
