"""A table that a stream's batches change, each exactly once: versions of its buckets and a ledger of batches.

A batch reads the buckets that it touches, writes them anew beside the old ones
and then notes them in the ledger; that note is what makes them count. A batch
that broke off before it is written again over its own files, one that comes
again after it changes nothing. Readers see the table as of a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "run string, batch long, version long, bucket int"


class Versions:
    """merge(rows of touched buckets, rows of a batch) gives these buckets' new rows; both have key.

    run names the stream: batches are numbered anew from a new checkpoint, and
    then need a new run. buckets bounds the files' number and the ledger's
    rows for each batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64, run: str = "main"):
        self.spark, self.path, self.schema, self.key, self.merge, self.buckets, self.run = spark, path.rstrip("/"), schema, key, merge, buckets, run

    def _ledger(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger") if there else self.spark.createDataFrame([], _LEDGER)

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _read(self, touched: list[int] | None = None) -> DataFrame:
        """The newest noted version of each bucket: no more paths than there are buckets."""
        ledger = self._ledger() if touched is None else self._ledger().where(F.col("bucket").isin(touched))
        newest = ledger.where("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version")).collect()
        paths = [f"{self.path}/version={r['version']}/bucket={r['bucket']}" for r in newest]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read()

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: the batch's rows merged into the table, unless the ledger has it."""
        ledger = self._ledger().cache()
        try:
            if ledger.where((F.col("run") == self.run) & (F.col("batch") == number)).count():
                return
            version = (ledger.agg(F.max("version")).first()[0] or 0) + 1
        finally:
            ledger.unpersist()
        batch = batch.persist()
        try:
            touched = [r[0] for r in self._of(batch).select("bucket").distinct().collect()]
            new = self._of(self.merge(self._read(touched), batch))
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        finally:
            batch.unpersist()
        # One file of a few rows, which its writer moves into place as a whole: this commits the batch.
        notes = [(self.run, number, version, b) for b in touched] or [(self.run, number, version, -1)]
        self.spark.createDataFrame(notes, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
