"""The best candidates of every job among all candidates, and means over all jobs, without pairing all with all.

Jobs that ask the same and candidates that offer the same are one class each.
Skill tokens meet in an index of the vocabulary. A job's tokens are taken up from
the rarest on: who has not met it yet can at most have the tokens that are left,
so once the k-th best is better than those and full marks for experience and
degree, the rest needs no score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.functions import scoring, skills
from crestline.operators.positions import running
from crestline.sources.scratch import stored

#: How far scores are compared, in digits.
DIGITS = 9
CLASS = ["wanted", "least", "need"]


def token_matches(wanted: DataFrame, had: DataFrame) -> DataFrame:
    """w, e: which tokens of wanted (w) the expanded tokens of had (e) satisfy, each column's values distinct.

    By a common expansion, or one inside the other where both are long enough:
    the first LONG_ENOUGH letters of the inner token are a stretch of the outer.
    """
    n = skills.LONG_ENOUGH
    of_each = wanted.select("w", F.explode(F.element_at(skills.expand_each(F.array("w")), 1)).alias("e")).join(had, "e")
    long = lambda df, c: df.where(F.length(c) >= n)
    stretches = lambda df, c: long(df, c).select(c, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n))))).alias("g"))
    heads = lambda df, c: long(df, c).select(c, F.substring(c, 1, n).alias("g"))
    inside = heads(wanted, "w").join(stretches(had, "e"), "g").where(F.contains("e", "w"))
    around = stretches(wanted, "w").join(heads(had, "e"), "g").where(F.contains("w", "e"))
    return of_each.select("w", "e").unionByName(inside.select("w", "e")).unionByName(around.select("w", "e")).distinct()


def _text(c) -> Column:
    """A skill string as its distinct tokens in order, a line each: what asks or offers the same is equal."""
    return F.array_join(F.array_sort(skills.parse_skills(c)), "\n")


def _tokens(c: str) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x != "")


class Index:
    """satisfied (had, w): which wanted tokens each class of skills satisfies; asked (wanted, w, size): the tokens of each wanted list."""

    def __init__(self, jobs: DataFrame, candidates: DataFrame):
        self.jobs = stored(jobs.select("job_id", _text(F.col("skills")).alias("wanted"), F.col("min_experience").cast("double").alias("least"), scoring.degree_rank(F.col("education_required")).alias("need")), "jobs")
        own = candidates.select("candidate_id", _text(F.col("skills")).alias("had"), F.col("years").cast("double").alias("years"), scoring.degree_rank(F.col("degree")).alias("rank"))
        self.candidates = stored(own, "candidates")
        tokens = self.jobs.select("wanted").distinct().withColumn("size", F.size(_tokens("wanted")))
        self.asked = stored(tokens.select("wanted", "size", F.explode(_tokens("wanted")).alias("w")), "asked")
        each = self.candidates.select("had").distinct().select("had", F.explode(skills.expand(_tokens("had"))).alias("e"))
        matches = token_matches(self.asked.select("w").distinct(), each.select("e").distinct())
        self.satisfied = stored(each.join(matches, "e").select("had", "w").distinct(), "satisfied")

    def skill(self, pairs: DataFrame) -> DataFrame:
        """wanted, had, skill of pairs of both."""
        met = pairs.join(self.asked, "wanted").join(self.satisfied, ["had", "w"]).groupBy("wanted", "had", "size").agg(F.count(F.lit(1)).alias("m"))
        return pairs.join(met.select("wanted", "had", (F.col("m") / F.col("size")).alias("skill")), ["wanted", "had"], "left").na.fill(0.0, ["skill"])


def _edu() -> Column:
    return F.when(F.col("need").isNull(), 0.5).when(F.col("rank").isNull(), 0.0).when(F.col("rank") >= F.col("need"), 1.0).otherwise(0.0)


def _scored(rows: DataFrame) -> DataFrame:
    """rows (class of a job, skill, years, rank) with exp, edu and weak."""
    parts = rows.withColumns({"exp": scoring.exp_score(F.col("years"), F.col("least")), "edu": _edu()})
    return parts.withColumn("weak", F.bround(scoring.weak_score(F.col("skill"), F.col("exp"), F.col("edu")), DIGITS))


def _first(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each group; a task passes on no more than k of a group."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).drop("place")


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal; the columns come once."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"_{c}" for c in on])


def best_candidates(jobs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """job_id, place, candidate_id, skill, exp, edu, weak: the k best of all candidates for each job by the weak score, ties to the smaller id.

    jobs has job_id, skills, min_experience, education_required; candidates
    candidate_id, skills, years, degree. Equal to scoring each pair: a null or
    empty list of skills asks for nothing or offers nothing, unknown years and
    degrees count as in the score. Without candidates there are no rows.
    """
    index = Index(jobs, candidates)
    order = [F.desc("weak"), F.asc("candidate_id")]
    classes = stored(index.jobs.select(*CLASS).distinct().join(index.asked.select("wanted", "size").distinct(), "wanted", "left").na.fill(0, ["size"]), "classes")
    # Of candidates that offer the same, the k with the smallest ids are enough.
    same = stored(_first(index.candidates, ["had", "years", "rank"], [F.asc("candidate_id")], k), "same")
    spread = index.candidates.groupBy("had").agg(F.count(F.lit(1)).alias("n")).join(index.satisfied, "had").groupBy("w").agg(F.sum("n").alias("n"))
    rarest = F.row_number().over(W.partitionBy("wanted").orderBy("n", "w"))
    ordered = stored(index.asked.join(spread, "w", "left").na.fill(0, ["n"]).select("wanted", "w", rarest.alias("turn")), "ordered")
    # Who is best by experience and degree alone stands for all that match nothing.
    asked = classes.select("least", "need").distinct().withColumn("skill", F.lit(0.0))
    offers = _first(same, ["years", "rank"], [F.asc("candidate_id")], k)
    met = asked.select("*", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("level")).join(offers.withColumn("level", F.coalesce("rank", F.lit(0))), "level")
    alone = _first(_scored(met), ["least", "need"], order, k).select("least", "need", "had", "years", "rank", "candidate_id")
    found = _joined(classes, alone, ["least", "need"])
    seen = stored(found.select("wanted", "had").distinct(), "seen")
    shown = [*CLASS, "size", "candidate_id", "skill", "exp", "edu", "weak"]
    best = stored(_first(_scored(found.join(index.skill(seen), ["wanted", "had"])).select(shown), CLASS, order, k), "best")
    met_before = seen.where("false")
    for turn in range(1, (classes.agg(F.max("size")).first()[0] or 0) + 1):
        # What a class has yet to meet shares no token with it but those of later turns.
        kth = best.groupBy(*CLASS, "size").agg(F.min("weak").alias("kth"), F.count(F.lit(1)).alias("held"))
        left = 0.7 * (F.col("size") - (turn - 1)) / F.col("size") + 0.3
        open_ = stored(kth.where((F.col("size") >= turn) & ((F.col("held") < k) | (F.col("kth") <= left))).select(*CLASS, "size"), "open")
        if open_.isEmpty():
            break
        new = open_.select("wanted").distinct().join(ordered.where(F.col("turn") == turn), "wanted").join(index.satisfied, "w").select("wanted", "had")
        new = stored(new.join(met_before, ["wanted", "had"], "left_anti"), "new")
        met_before = stored(met_before.unionByName(new), "met")
        scored = _scored(open_.join(index.skill(new), "wanted").join(same, "had")).select(shown)
        best = stored(_first(best.unionByName(scored).distinct(), CLASS, order, k), "best")
    out = _joined(index.jobs, best.drop("size"), CLASS)
    place = F.row_number().over(W.partitionBy("job_id").orderBy(*order)).cast("int")
    return out.select("job_id", place.alias("place"), "candidate_id", "skill", "exp", "edu", "weak")


def mean_scores(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, mean_score: the mean weak score over all jobs, six digits.

    Each part of the score is averaged by itself: skills over the vocabulary,
    experience by sums over the sorted requirements, degrees by level. So the
    work grows with jobs plus candidates. Without jobs there are no rows.
    """
    index = Index(jobs, candidates)
    n = index.jobs.count()
    if not n:
        return candidates.select("candidate_id", F.lit(None).cast("double").alias("mean_score")).where("false")
    worth = index.jobs.select("wanted").join(index.asked, "wanted").groupBy("w").agg(F.sum(1.0 / F.col("size")).alias("worth"))
    skill = index.satisfied.join(worth, "w").groupBy("had").agg((F.sum("worth") / n).alias("skill"))
    # For y years: 1 for each requirement up to y, y over each beyond; half for each job without one.
    least = index.jobs.where("least is not null").groupBy(F.greatest("least", F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    free = n - (least.agg(F.sum("n")).first()[0] or 0)
    beyond = least.select("x", F.lit(0).alias("asks"), "n", F.when(F.col("x") > 0, F.col("n") / F.col("x")).otherwise(0.0).alias("inverse"))
    years = index.candidates.where("years is not null").select(F.col("years").alias("x"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("inverse")).distinct()
    line = running(beyond.unionByName(years), "n", F.col("x"), F.col("asks"), name="met")
    line = running(line, "inverse", F.col("x"), F.col("asks"), name="sum")
    whole = least.agg(F.sum(F.when(F.col("x") > 0, F.col("n") / F.col("x")).otherwise(0.0))).first()[0] or 0.0
    met = line.where("asks = 1").select(F.col("x").alias("years"), ((F.col("met") + F.col("x") * (F.lit(whole) - F.col("sum")) + 0.5 * free) / n).alias("exp"))
    need = index.jobs.groupBy("need").agg(F.count(F.lit(1)).alias("n"))
    levels = index.candidates.select("rank").distinct().select("rank", F.explode(F.array(F.lit(None).cast("int"), *[F.lit(i) for i in range(1, 5)])).alias("need"))
    edu = _joined(levels, need, ["need"]).groupBy("rank").agg((F.sum(_edu() * F.col("n")) / n).alias("edu"))
    rows = _joined(index.candidates, edu, ["rank"]).join(skill, "had", "left").join(met, "years", "left")
    exp = F.when(F.col("years").isNull(), F.lit(0.5 * free / n)).otherwise(F.col("exp"))
    return rows.select("candidate_id", F.bround(0.70 * F.coalesce("skill", F.lit(0.0)) + 0.20 * exp + 0.10 * F.col("edu"), 6).alias("mean_score"))
