"""Percentiles, best jobs, shortlists, saved rankings and ranking measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.functions import scoring, skills
from crestline.operators.positions import numbered, running
from crestline.sources.scratch import stored

#: Fixed value: weights of years, skills, education and certificates in a profile score.
PROFILE_WEIGHTS = {"years": 0.32, "n_skills": 0.32, "education": 0.24, "certified": 0.12}


def mean_ranks(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """column, value, mean_rank (from 0, ties sharing it) of the distinct values of each column, as doubles, and the number of rows.

    The values of all columns are counted and then ranked together, range by
    range; no task holds a column's values, and no window the rows.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
    counts = df.select(each.alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("k"))
    n = df.count()
    # Each column's counts sum to n.
    below = running(counts, "k", F.col("column"), F.col("value"), name="below")
    return below.select("column", "value", (F.col("below") - n * F.col("column") + (F.col("k") - 1) / 2.0).alias("mean_rank")), n


def percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column v a column v_pct: 100 times the mean rank, ties sharing it, over n - 1; alone it is 50."""
    ranks, n = mean_ranks(df, columns)
    ranks = stored(ranks, "ranks")
    for i, c in enumerate(columns):
        pct = F.lit(50.0) if n == 1 else 100.0 * F.col("mean_rank") / (n - 1)
        df = df.join(ranks.where(F.col("column") == i).select(F.col("value").alias(c), pct.alias(f"{c}_pct")), c)
    return df


#: What a degree's text has to hold for each level, the highest first.
EDUCATION = [
    (5.0, r"\b(ph\.?\s*d|doctorate|doctoral)\b"),
    (4.5, r"\b(m\.?\s*phil|mphil)\b"),
    (4.0, r"\b(m\.?\s*s|m\.?\s*sc|master|mba|m\.?\s*eng)\b"),
    (3.0, r"\b(b\.?\s*s|b\.?\s*sc|bachelor|be\b|beng|b\.?\s*a|undergraduate)\b"),
    (2.0, r"\b(intermediate|associate|diploma|a[-\s]?level)\b"),
    (1.0, r"\b(high school|matric|ssc|o[-\s]?level|ged)\b"),
]
#: What a candidate's title adds to the blended score, the first that it holds.
TITLE_BOOSTS = [("backend", 0.03), ("full stack", 0.015), ("fullstack", 0.015)]


def education_ordinal(degree: Column) -> Column:
    """The level of a degree's text: 0 for none, 0.5 for what no pattern knows."""
    d = F.trim(F.regexp_replace(F.lower(F.coalesce(degree, F.lit(""))), r"\s+", " "))
    out = F.when(d == "", 0.0)
    for level, pattern in EDUCATION:
        out = out.when(d.rlike(pattern), level)
    return out.otherwise(0.5)


def profile_scores(candidates: DataFrame) -> DataFrame:
    """candidate_id, profile_score: percentiles within the cohort, weighted."""
    pieces = F.filter(F.split("skills", "[,;|]"), lambda x: F.trim(x) != "")
    base = candidates.select("candidate_id", F.greatest(F.coalesce("years", F.lit(0.0)), F.lit(0.0)).alias("years"), F.size(pieces).cast("double").alias("n_skills"), education_ordinal(F.col("degree")).alias("education"), F.when(F.trim("certifications") != "", 1.0).otherwise(0.0).alias("certified"))
    ranked = percentiles(base, list(PROFILE_WEIGHTS))
    total = sum((F.lit(w) * F.col(f"{c}_pct") for c, w in PROFILE_WEIGHTS.items()), F.lit(0.0))
    return ranked.select("candidate_id", F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 2).alias("profile_score"))


def competition_scores(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """Half the profile, half the mean fit for jobs; without jobs the profile alone."""
    fit = rankings.groupBy("candidate_id").agg((F.avg("score") * 100).alias("job_fit"))
    out = profile_scores(candidates).join(fit, "candidate_id", "left")
    return out.select("candidate_id", F.bround(F.when(F.col("job_fit").isNull(), F.col("profile_score")).otherwise(0.5 * F.col("profile_score") + 0.5 * F.col("job_fit")), 6).alias("competition_score"))


def best_jobs(rankings: DataFrame, applicants: DataFrame) -> DataFrame:
    """Each candidate's best job among those applied for, ties to the lower id, and its score in percent."""
    pairs = rankings.join(applicants.select("job_id", "candidate_id"), ["job_id", "candidate_id"], "left_semi")
    best = pairs.groupBy("candidate_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "job_id")).alias("b"))
    return best.select("candidate_id", F.col("b.job_id").alias("best_job_id"), F.bround(100 * scoring.clamp(-F.col("b.s")), 4).alias("best_score"))


def saved_rankings(rankings: DataFrame, k: int) -> DataFrame:
    """The first k of each job by score, similarity and id, numbered."""
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("score"), F.desc("similarity"), "candidate_id"))
    return rankings.withColumn("place", place).where(F.col("place") <= k).select("job_id", F.col("place").cast("int").alias("place"), "candidate_id", F.bround("score", 4).alias("score"))


#: Fixed value: how many missing skills an explanation lists.
MOST_MISSING = 30


def skill_scores(strings: DataFrame) -> DataFrame:
    """wanted and had, two skill strings, with what they have in common and what lacks. Each string is parsed and expanded once."""
    wanted = strings.select("wanted").distinct().withColumn("job_skills", skills.parse_skills(F.col("wanted")))
    wanted = wanted.withColumn("job_expanded", skills.expand_each(F.col("job_skills")))
    had = strings.select("had").distinct().withColumn("cand_skills", skills.parse_skills(F.col("had")))
    had = had.withColumn("cand_expanded", skills.expand(F.col("cand_skills")))
    asked, own = F.col("job_skills"), F.col("cand_skills")
    lacks = lambda a: F.slice(F.array_sort(F.array_except(a, own)), 1, MOST_MISSING)
    return strings.join(wanted, "wanted").join(had, "had").select(
        "wanted", "had", skills.covered(asked, own).alias("ratio"), skills.covered(skills.critical(asked), own).alias("critical_coverage"), lacks(skills.critical(asked)).alias("missing_critical"), skills.overlap(asked, F.col("job_expanded"), F.col("cand_expanded")).alias("skill"),
        skills.weighted_coverage(asked, own).alias("coverage"), lacks(asked).alias("missing"),
    )


#: A table of at most so many pairs of skill lists is made of all lists, whether they meet or not, and goes to every task.
MOST_LISTS = 50_000


def _scored_lists(jobs: DataFrame, candidates: DataFrame) -> DataFrame | None:
    """skill_scores of all jobs' lists with all candidates', or None if these are too many."""
    wanted, had = stored(jobs.select("wanted").distinct(), "wanted"), stored(candidates.select("had").distinct(), "had")
    if wanted.count() * had.count() > MOST_LISTS:
        return None
    return F.broadcast(skill_scores(wanted.crossJoin(had)))  # at most MOST_LISTS rows


def pair_scores(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, carry: list[str] | None = None, of_job: list[str] | None = None) -> DataFrame:
    """job_id, candidate_id and all parts of the weak score, for given pairs. Skill strings that meet more than once are compared once.

    Pairs count once; with carry, columns of pairs to keep, each of their rows
    does. of_job names columns of jobs to keep.
    """
    j = jobs.select("job_id", "min_experience", "education_required", F.coalesce("skills", F.lit("")).alias("wanted"), *(of_job or []))
    c = candidates.select("candidate_id", "years", "degree", F.coalesce("skills", F.lit("")).alias("had"))
    given = pairs.select("job_id", "candidate_id", *carry) if carry else pairs.select("job_id", "candidate_id").distinct()
    both = given.join(j, "job_id").join(c, "candidate_id")
    lists = _scored_lists(j, c) if carry else None
    if lists is None:
        lists = skill_scores(both.select("wanted", "had").distinct())
    scored = both.join(lists, ["wanted", "had"]).withColumns({
        "exp": scoring.exp_score(F.col("years"), F.col("min_experience")),
        "band": scoring.experience_band(F.col("years"), F.col("min_experience"), F.lit(None).cast("double")),
        "edu": scoring.edu_score(F.col("degree"), F.col("education_required")),
    })
    return scored.withColumn("weak", scoring.weak_score(F.col("skill"), F.col("exp"), F.col("edu")))


def explanations(rankings: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Why each ranked pair scores as it does: shares and scores to four digits, missing skills in order of the alphabet."""
    scored = pair_scores(rankings, jobs, candidates).join(rankings.select("job_id", "candidate_id", "score", "similarity"), ["job_id", "candidate_id"])
    final = scoring.adjusted_match(F.col("score"), F.col("similarity"), F.col("skill"), F.col("band"))
    parts = {
        "skills_match_ratio": F.col("ratio"),
        "normalized_skill_overlap": F.col("skill"),
        "total_skill_coverage": F.col("coverage"),
        "critical_skill_coverage": F.col("critical_coverage"),
        "experience_match": F.col("exp"),
        "education_match": F.col("edu"),
        "heuristic_weak_score": F.col("weak"),
        "score_raw": F.col("score"),
        "score": final,
    }
    return scored.select("job_id", "candidate_id", *[F.bround(c, 4).alias(n) for n, c in parts.items()], F.col("missing").alias("missing_skills"), F.col("missing_critical").alias("missing_critical_skills"))


def shortlist(rankings: DataFrame, applicants: DataFrame, least: float, k: int) -> DataFrame:
    """The k most similar of each job above a threshold, and its applicants whatever they score, each once, numbered."""
    scored = rankings.select("job_id", "candidate_id", "similarity")
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("similarity"), "candidate_id"))
    top = scored.where(F.col("similarity") >= least).withColumn("p", place).where(F.col("p") <= k).select("job_id", "candidate_id", "similarity", F.lit(False).alias("forced"))
    forced = applicants.select("job_id", "candidate_id").distinct().join(top, ["job_id", "candidate_id"], "left_anti").join(scored, ["job_id", "candidate_id"], "left").select("job_id", "candidate_id", "similarity", F.lit(True).alias("forced"))
    order = F.row_number().over(W.partitionBy("job_id").orderBy("forced", F.desc_nulls_last("similarity"), "candidate_id"))
    return top.unionByName(forced).select("job_id", order.alias("place"), "candidate_id", "forced", F.bround("similarity", 4).alias("similarity"))


def hypothetical_rank(rankings: DataFrame, scores: list[float]) -> DataFrame:
    """Where a new score would stand in each job. A job's scores are counted for all new scores at once, before these become rows."""
    above = F.array(*[F.struct(F.lit(x).alias("x"), (F.count_if(F.col("score") > x) + 1).alias("place")) for x in scores])
    by_job = rankings.groupBy("job_id").agg(above.alias("above"), F.count(F.lit(1)).alias("pool"))
    return by_job.select("job_id", F.explode("above").alias("a"), "pool").select("job_id", "a.x", "a.place", "pool")


def title_boost(title: Column) -> Column:
    t, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(0.0)
    for part, boost in reversed(TITLE_BOOSTS):
        out = F.when(F.contains(t, F.lit(part)), boost).otherwise(out)
    return out


def ensemble(rankings: DataFrame, weak: DataFrame, candidates: DataFrame) -> DataFrame:
    """0.2 weak + 0.3 lexical + 0.5 model score and the title's boost; what is missing counts 0."""
    out = rankings.join(weak.select("job_id", "candidate_id", "weak"), ["job_id", "candidate_id"], "left").join(candidates.select("candidate_id", "title"), "candidate_id", "left").na.fill({"weak": 0.0})
    return out.select("job_id", "candidate_id", F.bround(0.2 * F.col("weak") + 0.3 * F.col("similarity") + 0.5 * F.col("score") + title_boost(F.col("title")), 4).alias("final_score"))


def pool_rank(candidates: DataFrame, score: Column, preview: float, cap: int = 400, least_text: int = 30) -> DataFrame:
    """Where a score would stand among the newest candidates: rank, ranked, capped and considered, in one row.

    The pool is the cap (50 to 5000) newest rows, ties to the smaller id; those
    whose text is shorter than least_text are considered but not ranked.
    candidates has candidate_id, created_at and text.
    """
    cap = max(50, min(cap, 5000))
    pool = candidates.orderBy(F.desc("created_at"), "candidate_id").limit(cap)
    enough = F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_text
    return pool.select(enough.alias("enough"), score.alias("score")).agg(
        (F.count_if(F.col("enough") & (F.col("score") > preview)) + 1).alias("position"), F.count_if("enough").alias("ranked"), (F.count(F.lit(1)) >= cap).alias("capped"), F.count(F.lit(1)).alias("considered")
    )


def ranking_metrics(df: DataFrame, k: int = 10, relevant: float = 0.5) -> DataFrame:
    """Means over queries of Spearman, NDCG (ideal order of the first k), precision, recall and average precision.

    df has query, item, truth and predicted. Items with equal predictions come by item.
    """
    by_query = W.partitionBy("query")
    # Mean ranks share a sort with what is numbered in the same order: three sorts in all, each of a query's rows.
    mean_rank = lambda order: F.rank().over(by_query.orderBy(order)) + (F.count(F.lit(1)).over(by_query.orderBy(order).rangeBetween(W.currentRow, W.currentRow)) - 1) / 2.0
    said = by_query.orderBy(F.desc("predicted"), "item")
    ranked = df.withColumn("hit", (F.col("truth") >= relevant).cast("int"))
    ranked = ranked.withColumns({"place": F.row_number().over(said), "hits": F.sum("hit").over(said.rowsBetween(W.unboundedPreceding, 0))})
    # From the largest prediction down, so with the other sign.
    ranked = ranked.withColumn("rp", -mean_rank(F.desc("predicted")))
    ranked = ranked.withColumns({"top": F.col("place") <= k, "precision_here": F.col("hits") / F.col("place")})
    ranked = ranked.withColumn("ideal", F.row_number().over(by_query.orderBy(F.desc("top"), F.desc("truth"), "item")))
    ranked = ranked.withColumn("rt", mean_rank(F.asc("truth")))
    gain = lambda place: F.sum(F.when(F.col("top"), F.col("truth") / F.log2(F.col(place) + 1.0)))
    each = ranked.groupBy("query").agg(
        F.corr("rt", "rp").alias("spearman"), F.try_divide(gain("place"), gain("ideal")).alias("ndcg"), (F.sum(F.when(F.col("top"), F.col("hit")).otherwise(0)) / F.least(F.lit(k), F.count(F.lit(1)))).alias("precision"),
        F.try_divide(F.sum(F.when(F.col("top"), F.col("hit")).otherwise(0)), F.sum("hit")).alias("recall"), F.try_divide(F.sum(F.col("hit") * F.col("precision_here")), F.sum("hit")).alias("ap"),
    )
    mean = lambda c: F.bround(F.avg(F.when(~F.isnan(F.coalesce(c, F.lit(0.0))), F.coalesce(c, F.lit(0.0)))), 4)
    return each.agg(F.count(F.lit(1)).alias("queries"), F.bround(F.avg(F.when(~F.isnan("spearman"), F.col("spearman"))), 4).alias("spearman"), *[mean(F.col(c)).alias(c) for c in ("ndcg", "precision", "recall", "ap")])


def classification_report(df: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, F1; df has truth and predicted. A class without predictions has precision 0."""
    cells = df.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    per = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").cast("int").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    sums = per.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    p, r = F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    return sums.select("label", "support", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"))


def regression_metrics(df: DataFrame) -> DataFrame:
    d = F.col("predicted") - F.col("truth")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(d * d), 4).alias("mse"), F.bround(F.avg(F.abs(d)), 4).alias("mae"))


def classification_summary(df: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro means of precision, recall and F1 over all classes that occur, micro F1; df has truth and predicted.

    A class that is never said, or never true, counts with 0. Each row has one
    class, so micro F1 is the accuracy. Rows with a null on either side are left out.
    """
    cells = df.where("truth is not null and predicted is not null").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), hit.alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit"))))
    sums = cells.select(sides.alias("x")).select("x.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    p, r = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("support"))
    mean = lambda c, name: F.bround(F.avg(c), 4).alias(name)
    accuracy = F.bround(F.try_divide(F.sum("hit"), F.sum("support")), 4)
    return sums.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("n"), accuracy.alias("accuracy"), mean(p, "macro_precision"), mean(r, "macro_recall"), mean(share(2 * p * r, p + r), "macro_f1"), accuracy.alias("micro_f1"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """truth, predicted, n for each pair of classes that occur on either side, zeros included; the classes are few and known to the reader."""
    cells = df.where("truth is not null and predicted is not null").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    labels = cells.select("truth").unionByName(cells.select(F.col("predicted").alias("truth"))).distinct()
    rows = labels.agg(F.sort_array(F.collect_list("truth")).alias("all")).select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("predicted"))
    return rows.join(cells, ["truth", "predicted"], "left").na.fill(0, ["n"])


def spearman(df: DataFrame) -> DataFrame:
    """One row: n and the correlation of the mean ranks of truth and predicted; null if either is constant. Rows with a null are left out."""
    whole = df.where("truth is not null and predicted is not null").select(F.col("truth").cast("double").alias("truth"), F.col("predicted").cast("double").alias("predicted"))
    ranks, _ = mean_ranks(whole, ["truth", "predicted"])
    ranks = stored(ranks, "ranks")
    for i, c in enumerate(["truth", "predicted"]):
        whole = whole.join(ranks.where(F.col("column") == i).select(F.col("value").alias(c), F.col("mean_rank").alias(f"{c}_rank")), c)
    rho = F.try_divide(F.covar_pop("truth_rank", "predicted_rank"), F.stddev_pop("truth_rank") * F.stddev_pop("predicted_rank"))
    return whole.agg(F.count(F.lit(1)).alias("n"), F.bround(rho, 4).alias("spearman"))


def split_stratified(df: DataFrame, id_col: str, by: str) -> DataFrame:
    """train, val or test by place within each stratum, in the order of the ids' hashes: 80, 10 and 10 of a hundred, rounded down.

    A stratum is numbered over ranges, so it may hold a third of all rows. Null strata are one.
    """
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(20))
    placed = numbered(df, F.col(by).asc_nulls_first(), order, F.col(id_col), name="_place")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = running(sizes, "_n", F.col(by).asc_nulls_first(), name="_below").withColumnRenamed(by, "_by")
    out = placed.join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    share = F.col("_place") - F.col("_below") - 1
    train, val = F.floor(0.8 * F.col("_n")), F.floor(0.9 * F.col("_n"))
    return out.withColumn("split", F.when(share < train, "train").when(share < val, "val").otherwise("test")).drop("_place", "_by", "_n", "_below")


def split_by_id(df: DataFrame, id_col: str) -> DataFrame:
    """train, val or test by the id alone, 80 to 10 to 10, so no id is in two of them."""
    bucket = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10))
    return df.withColumn("split", F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test"))
