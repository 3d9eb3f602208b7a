"""Values filled in or recomputed, of which only those that are new or changed are returned; exports and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators.listing import contains_any, paged

#: Fixed value: by how much a stored score has to differ to be written again.
CHANGED = 0.01
#: Fixed value: how much of a note is exported.
LONGEST_NOTE = 500


def workspace_backfill(candidates: DataFrame, links: list[DataFrame], jobs: DataFrame) -> DataFrame:
    """candidate_id, workspace_id of candidates that have none: that of a job from the first of links that knows one, the smallest job id.

    Candidates without any link are left out and stay without a workspace.
    """
    homes = jobs.where("workspace_id is not null").select("job_id", F.col("workspace_id").alias("home"))
    blank = candidates.where("workspace_id is null").select("candidate_id")
    found = [df.select("job_id", "candidate_id").join(blank, "candidate_id", "left_semi").select("job_id", "candidate_id", F.lit(i).alias("place")) for i, df in enumerate(links)]
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every.join(homes, "job_id").groupBy("candidate_id").agg(F.min(F.struct("place", "job_id", "home"))["home"].alias("workspace_id"))


def workspace_best_jobs(rankings: DataFrame, jobs: DataFrame, workspace: int) -> DataFrame:
    """Each candidate's best job among the rankings of one workspace, ties to the smaller id, and its score in percent; those without one are left out."""
    own = rankings.join(jobs.where(F.col("workspace_id") == workspace).select("job_id"), "job_id", "left_semi")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.coalesce("score", F.lit(0.0))))
    best = own.groupBy("candidate_id").agg(F.min(F.struct((-score).alias("s"), "job_id")).alias("b"))
    return best.select("candidate_id", F.col("b.job_id").alias("best_job_id"), F.bround(-F.col("b.s"), 4).alias("best_score"))


def changed_best(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of computed whose score or job is not what is stored; both have candidate_id, best_job_id and best_score."""
    was = stored.select("candidate_id", F.col("best_job_id").alias("old_job"), F.coalesce("best_score", F.lit(0.0)).alias("old_score"))
    far = F.abs(F.coalesce("old_score", F.lit(0.0)) - F.coalesce("best_score", F.lit(0.0))) > CHANGED
    return computed.join(was, "candidate_id", "left").where(far | ~F.col("old_job").eqNullSafe(F.col("best_job_id"))).select("candidate_id", "best_job_id", "best_score")


def feedback_export(feedback: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Feedback by time with the ids of its job and candidate, empty where they are gone, and its note in one line."""
    known = feedback.join(jobs.select("job_id", F.col("job_id").cast("string").alias("job")), "job_id", "left").join(candidates.select("candidate_id", F.col("candidate_id").cast("string").alias("candidate")), "candidate_id", "left")
    note = F.substring(F.replace(F.coalesce("notes", F.lit("")), F.lit("\n"), F.lit(" ")), 1, LONGEST_NOTE)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return known.orderBy("created_at", "feedback_id").select("feedback_id", empty(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_at"), empty("job").alias("job"), empty("candidate").alias("candidate"), "action", "score", note.alias("notes"))


def sample_by_group(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most so many rows of each group, by the digest of their key: the same rows every time, whatever the partitions.

    Spark keeps only the first of each group before it shuffles, so a group of any size is cut in its own tasks.
    """
    place = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def job_board(jobs: DataFrame, clients: DataFrame, applicants: DataFrame, candidate: int, needle: str, offset: int, limit: int) -> DataFrame:
    """A page of the active jobs that any workspace has posted, the newest first, and whether the candidate has applied."""
    found = jobs.where((F.lower("status") == "active") & F.col("workspace_id").isNotNull() & contains_any(["title", "skills", "description"], needle))
    page = paged(found.select("job_id", "client_id", "title", "created_at"), [F.desc("created_at"), F.col("job_id")], offset, limit)
    mine = applicants.where(F.col("candidate_id") == candidate).select("job_id").distinct().withColumn("mine", F.lit(True))
    firm = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.trim("name"), F.lit(""))
    shown = page.join(clients.select("client_id", firm.alias("firm")), "client_id", "left").join(mine, "job_id", "left")
    return shown.select("job_id", "title", F.coalesce("firm", F.lit("")).alias("firm"), "total", F.coalesce("mine", F.lit(False)).alias("applied"))
