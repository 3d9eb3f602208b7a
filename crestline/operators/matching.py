"""The smart filter of ranked pairs and what follows from low scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions import matching as m
from crestline.functions import text


def smart_filter(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, least_similarity: float, least_overlap: float, carry: list[str] | None = None) -> DataFrame:
    """job_id, candidate_id, overlap: pairs that pass similarity, skills, role and title, in this order; carry names columns of pairs to keep.

    A job without skills asks for none. The title is not looked at where the
    job's role is unknown or the overlap is half as much again as needed. Each
    pair of skill lists and each pair of titles is compared once, however many
    pairs of rows share it.
    """
    text_of = lambda c: F.coalesce(c, F.lit(""))
    asked = jobs.select("job_id", text_of("skills").alias("wanted"), text_of("title").alias("job_title"), text.role_bucket(F.col("title")).alias("bucket"))
    own = candidates.select("candidate_id", text_of("skills").alias("have"), text_of("title").alias("title"), text_of("role_label").alias("role_label"))
    near = pairs.where(F.col("similarity") >= least_similarity).select("job_id", "candidate_id", *(carry or [])).join(asked, "job_id").join(own, "candidate_id")
    # Compared are aggregates rather than keys, as a filter on keys would be carried out for each row before the grouping.
    lists = near.groupBy("wanted", "have").agg(m.spelled(m.phrases(F.min("wanted"))).alias("w"), m.bag(m.phrases(F.min("have"))).alias("h"))
    compared = lists.select("wanted", "have", (F.size("w") > 0).alias("asks"), m.alias_overlap(F.col("w"), F.col("h")).alias("overlap"))
    names = ["bucket", "job_title", "title", "role_label"]
    role, guard = text.matches_role(F.col("b"), F.col("t"), F.col("l")), m.title_guard(F.col("j"), F.col("t"), F.col("l"))
    titled = near.groupBy(*names).agg(*[F.min(n).alias(n[0]) for n in ("bucket", "job_title", "title")], F.min("role_label").alias("l")).where(role).select(*names, ((F.col("b") == "other") | guard).alias("near_title"))
    strong = F.col("asks") & (F.col("overlap") >= least_overlap * 1.5)
    enough = compared.where(~F.col("asks") | (F.col("overlap") >= least_overlap))
    return near.join(enough, ["wanted", "have"]).join(titled, names).where(strong | F.col("near_title")).select("job_id", "candidate_id", "overlap", *(carry or []))


def low_matches(rankings: DataFrame, threshold: float) -> DataFrame:
    """job_id, low: how many of a job's ranked candidates score below the threshold, for jobs with any."""
    score = F.coalesce("score", "similarity", F.lit(0.0))
    return rankings.groupBy("job_id").agg(F.count_if(score < threshold).alias("low")).where("low > 0")
