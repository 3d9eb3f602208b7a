"""Saved rankings that are brought up to date where something changed, partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.functions import scoring
from crestline.operators import ranking
from crestline.sources.scratch import stored

PARTITION = ["workspace_id", "job_bucket"]
SAVED = "job_id long, place int, candidate_id long, score double, similarity double"


def ranked(rankings: DataFrame, jobs: DataFrame, candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """job_id, place, candidate_id, score, similarity: each job's pairs by adjusted score, then similarity, then id.

    Scores are compared by nine digits. A pair whose job or candidate is not there has no place.
    by names columns of jobs that follow; rows that share them lie in one partition, sorted by them.
    """
    by = by or []
    both = ranking.pair_scores(rankings.select("job_id", "candidate_id", F.col("score").alias("raw"), "similarity"), jobs, candidates, ["raw", "similarity"], by)
    final = F.bround(scoring.adjusted_match(F.col("raw"), F.col("similarity"), F.col("skill"), F.col("band")), 9)
    rows = both.select("job_id", "candidate_id", final.alias("score"), "similarity", *by)
    rows = rows.repartition(*by) if by else rows
    order = W.partitionBy(*by, "job_id").orderBy(F.desc("score"), F.desc("similarity"), "candidate_id")
    return rows.select("job_id", F.row_number().over(order).alias("place"), "candidate_id", "score", "similarity", *by)


def changed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The keys whose row is new, gone or different; hashes of the rows are what is shuffled.

    Keys may repeat: their rows count as a set with repeats. Null keys are keys.
    """
    rest = sorted(c for c in after.columns if c not in key)
    marked = lambda df, sign: df.select(*key, F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in rest]).alias("_h"), F.lit(sign).alias("_sign"))
    left = marked(before, -1).unionByName(marked(after, 1)).groupBy(*key, "_h").agg(F.sum("_sign").alias("_n"))
    return left.where("_n <> 0").select(*key).distinct()


def affected_jobs(pairs: DataFrame, changed_jobs: DataFrame, changed_candidates: DataFrame, changed_pairs: DataFrame) -> DataFrame:
    """job_id of what has to be ranked anew: changed jobs, jobs of changed pairs, and those that have a changed candidate."""
    of_candidates = pairs.join(changed_candidates.select("candidate_id"), "candidate_id", "left_semi").select("job_id")
    return changed_jobs.select("job_id").unionByName(changed_pairs.select("job_id")).unionByName(of_candidates).where("job_id is not null").distinct()


class SavedRankings:
    """A Parquet table of ranked() rows, partitioned by workspace and a hash of the job.

    With many buckets a partition holds few jobs, and little is written again
    for those that did not change; with few there are fewer files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def rows(self) -> DataFrame:
        return self._all().where("job_id is not null").drop("job_bucket")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{SAVED}, workspace_id int, job_bucket int").parquet(self.path)

    def _placed(self, jobs: DataFrame) -> DataFrame:
        return jobs.withColumns({"workspace_id": F.col("workspace_id").cast("int"), "job_bucket": F.pmod(F.xxhash64("job_id"), F.lit(self.buckets)).cast("int")})

    def write(self, rankings: DataFrame, jobs: DataFrame, candidates: DataFrame) -> None:
        """All jobs."""
        ranked(rankings, self._placed(jobs), candidates, PARTITION).write.mode("overwrite").partitionBy(*PARTITION).parquet(self.path)

    def refresh(self, affected: DataFrame, rankings: DataFrame, jobs: DataFrame, candidates: DataFrame) -> None:
        """Ranks the affected jobs anew and overwrites only the partitions that they are or were in.

        Jobs that share such a partition keep their rows as they are. A
        partition that loses its last row is overwritten too: each one written
        has a row without a job, which rows() leaves out.
        """
        affected = stored(affected.select("job_id"), "affected")
        some = lambda df: df.join(affected, "job_id", "left_semi")
        here, old = some(self._placed(jobs)), self._all()
        touched = stored(some(old).select(*PARTITION).unionByName(here.select(*PARTITION)).distinct(), "touched")
        same = lambda c: old[c].eqNullSafe(touched[c])
        kept = old.join(touched, same("workspace_id") & same("job_bucket"), "left_semi").where("job_id is not null").join(affected, "job_id", "left_anti")
        marks = touched.select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in SAVED.split(", "))], *PARTITION)
        # What stays is written aside, as the partitions that it is read from are those that go.
        aside = stored(kept.unionByName(marks.select(*kept.columns)).repartition(*PARTITION), "kept")
        new = ranked(some(rankings), here, candidates, PARTITION)
        # Each side lies together by partitions already.
        aside.unionByName(new.select(*aside.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(self.path)
