"""Pipeline funnels: applications by status, with candidates who have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.status import effective, funnel_counts, normalised, priority


def without_applications(candidates: DataFrame, applicants: DataFrame) -> DataFrame:
    return candidates.join(applicants.select("candidate_id"), "candidate_id", "left_anti")


def _timed(applicants: DataFrame, candidates: DataFrame) -> DataFrame:
    return applicants.join(candidates.select("candidate_id", "created_at"), "candidate_id")


def global_funnel(applicants: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """One row: each application counts, and each candidate without one."""
    apps = _timed(applicants, candidates).select("status", "created_at")
    both = apps.unionByName(without_applications(candidates, applicants).select("status", "created_at"))
    return both.agg(*funnel_counts(effective(F.col("status"), F.col("created_at"), now)))


def job_funnel(applicants: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    return _timed(applicants, candidates).groupBy("job_id").agg(*funnel_counts(effective(F.col("status"), F.col("created_at"), now)))


def workspace_funnel(applicants: DataFrame, candidates: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """People, not applications: the status of highest priority that a candidate has in a workspace, ties to the first by name."""
    apps = _timed(applicants, candidates).join(jobs.select("job_id", "workspace_id"), "job_id")
    status = F.lower(F.trim(F.col("status")))
    best = apps.groupBy("workspace_id", "candidate_id").agg(F.min(F.struct((-priority(F.col("status"))).alias("p"), status.alias("status"), "created_at")).alias("b"))
    best = best.select("workspace_id", F.col("b.status").alias("status"), F.col("b.created_at").alias("created_at"))
    own = without_applications(candidates.where("workspace_id is not null"), applicants).select("workspace_id", "status", "created_at")
    return best.unionByName(own).groupBy("workspace_id").agg(*funnel_counts(effective(F.col("status"), F.col("created_at"), now)))


def stage_preview(applicants: DataFrame, candidates: DataFrame, newest: int = 1200, per_stage: int = 8) -> DataFrame:
    """The newest distinct people of each stage among the newest applications."""
    from pyspark.sql import Window as W

    recent = applicants.orderBy(F.desc("updated_at"), "job_id", "candidate_id", "status").limit(newest)
    s = normalised(F.col("status"))
    stage = F.when(s == "selected", "shortlisted").when(s.isin("new", "screened", "shortlisted", "interviewing", "hired", "rejected"), s).otherwise("new")
    people = recent.withColumn("stage", stage).groupBy("stage", "candidate_id").agg(F.max("updated_at").alias("updated_at"))
    ranked = people.withColumn("place", F.row_number().over(W.partitionBy("stage").orderBy(F.desc("updated_at"), "candidate_id")))
    return ranked.where(F.col("place") <= per_stage).join(candidates.select("candidate_id", "full_name"), "candidate_id").select("stage", F.col("place").cast("int").alias("place"), "candidate_id", "full_name")
