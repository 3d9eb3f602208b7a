"""Searched, sorted and paged lists, and joins that fill them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive search over several columns; LIKE's own signs in the needle keep their meaning."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return out


#: Other names of a job's status, and the statuses that one stands for.
JOB_STATUS_NAMES = {"inactive": "on_hold", "on-hold": "on_hold"}
JOB_STATUS_MEMBERS = {"on_hold": ["on_hold", "inactive"], "active": ["active"], "completed": ["completed"], "cancelled": ["cancelled"]}
#: The forms in which a bound of a range of dates may come.
DATE_FORMS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f")


def has_job_status(status: Column, wanted: str) -> Column:
    """Whether a job's status is the wanted one, by any of its names; an unknown one is an error."""
    name = (wanted or "").strip().lower()
    name = JOB_STATUS_NAMES.get(name, name)
    if name not in JOB_STATUS_MEMBERS:
        raise ValueError(f"status must be one of {', '.join(sorted(JOB_STATUS_MEMBERS))}")
    return status.isin(JOB_STATUS_MEMBERS[name])


def date_bound(raw: str | None) -> datetime | None:
    """A bound as a time; what has none of the known forms is no bound."""
    for form in DATE_FORMS:
        try:
            return datetime.strptime((raw or "")[:26], form)
        except ValueError:
            continue
    return None


def within_dates(at: Column, since: str | None, until: str | None) -> Column:
    """Whether at lies between two bounds, both of them included."""
    out = F.lit(True)
    for bound, inside in ((date_bound(since), at.__ge__), (date_bound(until), at.__le__)):
        if bound is not None:
            out = out & inside(F.lit(bound.isoformat(" ")).cast("timestamp_ntz"))
    return out


def jobs_filtered(jobs: DataFrame, status: str, since: str | None, until: str | None) -> DataFrame:
    return jobs.where(has_job_status(F.col("status"), status) & within_dates(F.col("created_at"), since, until))


def paged(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows of a page, and in each the number of all rows. Order has to be total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # total is one row


def jobs_page(jobs: DataFrame, clients: DataFrame, needle: str, offset: int, limit: int) -> DataFrame:
    found = jobs.where(contains_any(["title", "skills"], needle) & F.col("status").isin("active", "on_hold"))
    urgency = F.when(F.col("urgency") == "high", 0).when(F.col("urgency") == "medium", 1).when(F.col("urgency") == "low", 2).otherwise(3)
    page = paged(found.select("job_id", "client_id", "title", "status", "urgency"), [urgency, F.col("job_id")], offset, limit)
    return page.join(clients.select("client_id", F.col("name").alias("client_name")), "client_id", "left")


def candidates_page(candidates: DataFrame, needle: str, offset: int, limit: int) -> DataFrame:
    open_ = F.col("status").isNull() | (F.lower("status") != "hired")
    found = candidates.where(contains_any(["full_name", "title", "skills", "degree"], needle) & open_)
    return paged(found.select("candidate_id", "full_name", "title", "status"), [F.lower("full_name"), F.col("candidate_id")], offset, limit)


def applicant_list(applicants: DataFrame, rankings: DataFrame) -> DataFrame:
    """Applications by pair with the pair's score, the most advanced by time; no score is null."""
    last = applicants.groupBy("job_id", "candidate_id").agg(F.max(F.struct("updated_at", "status")).alias("x"))
    return last.join(rankings, ["job_id", "candidate_id"], "left").select("job_id", "candidate_id", F.col("x.status").alias("status"), F.bround("score", 4).alias("score"), F.bround("similarity", 4).alias("similarity"))


def job_evaluations(applicants: DataFrame, rankings: DataFrame) -> DataFrame:
    """Each candidate's jobs from either relation: applied or not, scored or not."""
    applied = applicants.select("job_id", "candidate_id").distinct().withColumn("applied", F.lit(True))
    both = applied.join(rankings.select("job_id", "candidate_id", "score"), ["job_id", "candidate_id"], "full")
    return both.select("candidate_id", "job_id", F.coalesce("applied", F.lit(False)).alias("applied"), F.bround("score", 4).alias("score"))


def my_applications(applicants: DataFrame, jobs: DataFrame, clients: DataFrame, rankings: DataFrame, candidate: int) -> DataFrame:
    """One candidate's applications with job, client and score."""
    mine = applicants.where(F.col("candidate_id") == candidate).groupBy("job_id").agg(F.max(F.struct("updated_at", "status")).alias("x"))
    scores = rankings.where(F.col("candidate_id") == candidate).select("job_id", "score")
    out = mine.join(jobs.select("job_id", "title", "client_id"), "job_id").join(clients.select("client_id", F.col("name").alias("client_name")), "client_id", "left").join(scores, "job_id", "left")
    return out.select("job_id", "title", "client_name", F.col("x.status").alias("status"), F.bround("score", 4).alias("score"))


def duplicate_contacts(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Rows whose lower-cased key occurs again, with a stable id of the key and the first row that has it."""
    keyed = rows.select(F.col(id_col).alias("id"), F.lower(key).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return keyed.join(groups, "key").select("id", "first_id", "copies", F.concat(F.lit("u_"), F.substring(F.sha2("key", 256), 1, 14)).alias("contact"))


def latest_runs(rankings: DataFrame) -> DataFrame:
    """Each job's last run: its time, its size and its first candidate by score."""
    last = rankings.withColumn("last", F.max("run_at").over(W.partitionBy("job_id"))).where(F.col("run_at") == F.col("last"))
    return last.groupBy("job_id").agg(F.unix_timestamp(F.first("last")).alias("run_at"), F.count(F.lit(1)).alias("ranked"), F.min(F.struct((-F.col("score")).alias("s"), "candidate_id"))["candidate_id"].alias("top_candidate"))


def application_scores(applicants: DataFrame, jobs: DataFrame, clients: DataFrame, rankings: DataFrame) -> DataFrame:
    """Each application with its job, its client's name and the preferred ranking's score in percent: the job's own workspace's, else the highest.

    rankings has job_id, candidate_id, workspace_id and score; the preferred one
    is aggregated, so a pair may have any number. Applications without a
    ranking have no score, jobs without a client no company.
    """
    own = jobs.select("job_id", "title", "client_id", F.col("workspace_id").alias("_own"))
    ranked = rankings.join(own.select("job_id", "_own"), "job_id")
    best = ranked.groupBy("job_id", "candidate_id").agg(F.max(F.struct(F.coalesce(F.col("workspace_id") == F.col("_own"), F.lit(False)).alias("mine"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("b"))
    company = F.trim(F.coalesce(F.nullif(F.col("company_name"), F.lit("")), "name", F.lit("")))
    firms = clients.select("client_id", company.alias("company"))
    out = applicants.join(own, "job_id").join(firms, "client_id", "left").join(best, ["job_id", "candidate_id"], "left")
    return out.select("job_id", "candidate_id", F.trim("title").alias("title"), F.coalesce("company", F.lit("")).alias("company"), F.trim(F.coalesce("status", F.lit("new"))).alias("status"), F.bround(F.col("b.score") * 100, 1).alias("match_score"), F.col("b.mine").alias("own_ranking"))
