"""Shortlists: refreshed with counters of what each step leaves, changed by hand, and shown."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators import matching
from crestline.operators.positions import numbered
from crestline.sources.scratch import stored


def _observed(observation: Observation, name: str) -> int:
    """A count that was observed; Spark leaves the observation out of a plan whose rows it knows to be none, and then has no value."""
    try:
        return observation.get[name]
    except Py4JJavaError as error:
        if "assertion failed" not in str(error):
            raise
        return 0


def refreshed_shortlist(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, applicants: DataFrame, least_similarity: float, least_overlap: float, k: int) -> tuple[DataFrame, dict[str, int]]:
    """(job_id, place, candidate_id, similarity, forced) and the counters pool, with_similarity, passed, filtered_out and forced.

    pairs are the visible candidates of each job with their similarity, null
    where none could be computed. The k most similar that pass the smart filter
    come first, then the job's applicants that are not among them. The counters
    are observed while the shortlist is written, so pairs are read once.
    """
    k, pair = max(1, min(k, 2000)), ["job_id", "candidate_id"]
    seen, passed, forced = Observation("pool"), Observation("passed"), Observation("forced")
    applied = applicants.select(*pair).distinct()
    pool = pairs.select(*pair, "similarity").observe(seen, F.count(F.lit(1)).alias("n"), F.count("similarity").alias("with_similarity"))
    pool = pool.join(applied.withColumn("applied", F.lit(True)), pair, "left")
    near = stored(pool.where((F.col("similarity") >= least_similarity) | F.col("applied")), "near")
    kept = matching.smart_filter(near, jobs, candidates, least_similarity, least_overlap, carry=["similarity"])
    kept = kept.observe(passed, F.count(F.lit(1)).alias("n")).select(*pair, "similarity")
    first = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("similarity"), "candidate_id"))
    top = stored(kept.withColumn("place", first).where(F.col("place") <= k).select("job_id", "candidate_id", "similarity", F.lit(False).alias("forced")), "top")
    others = applied.join(top, pair, "left_anti").join(near.select(*pair, "similarity"), pair, "left")
    others = others.select(*pair, F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.lit(True).alias("forced")).observe(forced, F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("job_id").orderBy("forced", F.desc("similarity"), "candidate_id")).cast("int")
    out = stored(top.unionByName(others).select("job_id", place.alias("place"), "candidate_id", "similarity", "forced"), "shortlist")
    counts = {"pool": _observed(seen, "n"), "with_similarity": _observed(seen, "with_similarity"), "passed": _observed(passed, "n"), "forced": _observed(forced, "n")}
    return out, counts | {"filtered_out": counts["with_similarity"] - counts["passed"]}


#: Statuses that being shortlisted lifts.
LIFTED = ["new", "screened"]


def changed_shortlist(shortlist: DataFrame, applicants: DataFrame, candidates: DataFrame, add: DataFrame, remove: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shortlist (job_id, candidate_id), the applicants and the candidates after pairs are removed and others added.

    What is removed goes first; a pair in both is added. A status is lifted to
    shortlisted from new, screened or none for pairs that were not on the list,
    never lowered, and stays when a pair is removed. An added pair without an
    application gets one. Only known candidates are added; blank ids are none.
    """
    pair = ["job_id", "candidate_id"]
    known = add.select(*pair).distinct().join(candidates.select("candidate_id").distinct(), "candidate_id", "left_semi").select(*pair)
    left = shortlist.select(*pair).distinct().join(remove.select(*pair), pair, "left_anti")
    new = known.join(left, pair, "left_anti")
    flag = lambda df, on: df.select(*on).distinct().withColumn("_new", F.lit(True))
    lifted = lambda null: F.when(F.col("_new") & (F.coalesce("status", F.lit(null)).isin(LIFTED)), "shortlisted").otherwise(F.col("status")).alias("status")
    there = applicants.join(flag(new, pair), pair, "left").select(*pair, lifted("new"))
    added = new.join(applicants.select(*pair), pair, "left_anti").withColumn("status", F.lit("shortlisted"))
    people = candidates.join(flag(new, ["candidate_id"]), "candidate_id", "left")
    people = people.select(*[lifted("new") if c == "status" else F.col(c) for c in candidates.columns])
    return left.unionByName(new), there.unionByName(added), people


SORTS = ["name_asc", "rank_asc", "match_desc", "score_desc"]


def shown_pool(pool: DataFrame, ranked: DataFrame, sort: str, top_k: int, needle: str = "", least_percent: int | None = None, audience: str = "all", only_top: bool = False) -> DataFrame:
    """The rows of a job's pool as a page shows them, numbered by place.

    pool has candidate_id, name, title, role, skills, is_public and similarity;
    ranked has candidate_id, rank and score, both a row for each candidate at
    most. With ranked rows only these are shown, top_k at most; without any,
    top_k only if asked for. least_percent leaves out ranked rows below it.
    """
    if sort not in SORTS:
        raise ValueError(f"sort is one of {SORTS}")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "title", "role", "skills")]))
    rows = pool.dropDuplicates(["candidate_id"]).join(ranked.select("candidate_id", "rank", "score"), "candidate_id", "left")
    if needle.strip():
        rows = rows.where(F.contains(hay, F.lit(needle.strip().lower())))
    if least_percent is not None:
        rows = rows.where(F.col("rank").isNull() | (F.floor(F.coalesce("score", F.lit(0.0)) * 100 + 0.5) >= least_percent))
    if audience != "all":
        rows = rows.where(F.coalesce("is_public", F.lit(False)) == (audience == "public"))
    any_ranked = not ranked.isEmpty()
    similar, match = F.desc(F.coalesce("similarity", F.lit(0.0))), F.desc(F.coalesce("score", F.lit(-1.0)))
    order: list[Column] = {"name_asc": [F.lower(F.coalesce("name", F.lit("")))], "rank_asc": [F.asc_nulls_last("rank"), similar], "match_desc": [match, similar], "score_desc": [match, similar] if any_ranked else [similar]}[sort]
    order.append(F.col("candidate_id"))
    if any_ranked:
        rows = rows.where("rank is not null")
    placed = numbered(rows, *order, name="place").withColumn("place", F.col("place").cast("int"))
    return placed.where(F.col("place") <= top_k) if any_ranked or only_top else placed
