"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV with a header; missing strings are empty, missing numbers null."""
    return spark.read.schema(schema).option("header", True).csv(path).na.fill("")


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").option("header", True).option("lineSep", "\r\n").csv(path)


def discover(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below root with a stable id of path and size; their content is not read unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.withColumn("file_id", F.substring(F.md5(F.concat_ws("::", "path", F.col("length").cast("string"))), 1, 12))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's non-null values where the key is there, and new's other rows."""
    other = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    columns = [key, *dict.fromkeys(c for c in [*old.columns, *new.columns] if c != key)]
    value = lambda c: F.coalesce(*([F.col(f"_new_{c}")] if c in new.columns else []), *([F.col(c)] if c in old.columns else [])).alias(c)
    return old.join(other, key, "full").select(key, *[value(c) for c in columns[1:]])
