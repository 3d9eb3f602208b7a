"""Hiring reports: key figures, jobs' performance, time to hire, clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADVANCED = ["shortlisted", "interviewing", "selected", "hired"]  # fixed values, of the stored status


def whole_days(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400))


def hire_time(applicants: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mean whole days from a job's creation to its hires, at least 0 each, by workspace."""
    hires = applicants.where("status = 'hired'").join(jobs.select("job_id", "workspace_id", "created_at"), "job_id")
    return hires.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("hires"), F.bround(F.avg(whole_days(F.col("created_at"), F.col("updated_at"))), 4).alias("avg_days"))


def report_kpis(applicants: DataFrame, rankings: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of figures over active jobs; each relation is read once."""
    active = jobs.where("status = 'active'").select("job_id")
    apps = applicants.join(active, "job_id", "left_semi")
    figures = apps.agg(F.count(F.lit(1)).alias("applications"), F.count_distinct("candidate_id").alias("applicants"), F.count_if(F.col("status").isin(ADVANCED)).alias("advanced"), F.count_if(F.col("status") == "hired").alias("hires"))
    ranked = rankings.join(active, "job_id", "left_semi").agg(F.count_distinct("candidate_id").alias("ranked"), F.bround(F.avg("score") * 100, 4).alias("avg_match"))
    both = figures.crossJoin(ranked).crossJoin(active.agg(F.count(F.lit(1)).alias("active_jobs")))  # one row each
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(100.0 * F.col(a), F.col(b)), 4), F.lit(0.0))
    return both.select("active_jobs", "applications", "applicants", "advanced", "hires", "ranked", "avg_match", share("hires", "advanced").alias("shortlist_accuracy"), (100 - share("advanced", "applications")).alias("time_saved"))


def job_performance(rankings: DataFrame, applicants: DataFrame, jobs: DataFrame, recent: int = 15, keep: int = 10) -> DataFrame:
    """The newest jobs by hires, then mean score."""
    listed = jobs.orderBy(F.desc("created_at"), "job_id").limit(recent).select("job_id", "title")
    scores = rankings.join(listed, "job_id", "left_semi").groupBy("job_id").agg(F.bround(F.avg("score") * 100, 4).alias("avg_score"))
    hires = applicants.where("status = 'hired'").join(listed, "job_id", "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("hires"))
    out = listed.join(scores, "job_id", "left").join(hires, "job_id", "left").na.fill({"avg_score": 0.0, "hires": 0})
    return out.orderBy(F.desc("hires"), F.desc("avg_score"), "job_id").limit(keep)


def ai_vs_manual(applicants: DataFrame, rankings: DataFrame, jobs: DataFrame) -> DataFrame:
    """By workspace: people who advanced, and how many of them had been ranked."""
    moved = applicants.where(F.col("status").isin(ADVANCED)).join(jobs.select("job_id", "workspace_id"), "job_id").select("workspace_id", "candidate_id").distinct()
    ranked = rankings.select("candidate_id").distinct().withColumn("ranked", F.lit(True))
    out = moved.join(ranked, "candidate_id", "left").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("advanced"), F.count_if("ranked").alias("ai"))
    return out.select("workspace_id", "advanced", "ai", F.bround(100.0 * F.col("ai") / F.col("advanced"), 4).alias("ai_share"))


def client_active_jobs(clients: DataFrame, jobs: DataFrame, workspace: int) -> DataFrame:
    """A workspace's clients, own or by a job, with their active jobs; a client without one counts 0."""
    by_job = jobs.where(F.col("workspace_id") == workspace).select("client_id").distinct()
    seen = clients.where(F.col("workspace_id") == workspace).select("client_id", "name").unionByName(clients.join(by_job, "client_id", "left_semi").select("client_id", "name")).distinct()
    active = jobs.where("status = 'active'").select("client_id", "job_id")
    return seen.join(active, "client_id", "left").groupBy("client_id", "name").agg(F.count("job_id").alias("active_jobs"))


def status_pie(jobs: DataFrame) -> DataFrame:
    """Jobs by status and their share in percent, to a tenth."""
    from pyspark.sql import Window as W

    counts = jobs.groupBy("workspace_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.bround(1000.0 * F.col("n") / F.sum("n").over(W.partitionBy("workspace_id"))) / 10)


def dashboard(jobs: DataFrame, candidates: DataFrame, applicants: DataFrame, now: Column) -> DataFrame:
    """One row of totals, and of what is new within a day."""
    day = now - F.expr("INTERVAL 1 DAY")
    a = jobs.agg(F.count_if(F.col("status") == "active").alias("active_jobs"), F.count(F.lit(1)).alias("jobs"))
    b = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("created_at") >= day).alias("new_candidates"))
    c = applicants.agg(F.count_if(F.col("status") == "hired").alias("hires"))
    return a.crossJoin(b).crossJoin(c)  # one row each
