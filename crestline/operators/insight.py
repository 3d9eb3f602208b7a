"""Why the first of a job's ranking stands before the second, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.functions import skills
from crestline.functions.resume import trimmed
from crestline.operators import ranking

#: From which score on a match is high or medium, how many common skills are named, the longest certificate.
HIGH, MEDIUM = 0.78, 0.62
MOST_NAMED, LONGEST_CERT = 6, 120


def percent(c: Column) -> Column:
    """A share as a whole percentage, as text."""
    return F.bround(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))).cast("long").cast("string")


def strength(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def plain_number(c: Column) -> Column:
    """A number that is not negative with six digits and no zeros behind."""
    rounded = F.when(c < 1, F.bround(c, 6)).when(c < 10, F.bround(c, 5)).otherwise(F.bround(c, 4))
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(rounded.cast("string"))


def text_of(c: str) -> Column:
    return trimmed(F.coalesce(F.col(c), F.lit("")))


def first_certificate(c: Column) -> Column:
    one = trimmed(F.split(F.split(c, r"\|")[0], ";")[0])
    return F.when(F.length(one) > LONGEST_CERT, F.concat(F.regexp_replace(F.substring(one, 1, LONGEST_CERT - 1), r"\s+$", ""), F.lit("…"))).otherwise(one)


def top_insight(rankings: DataFrame, jobs: DataFrame, candidates: DataFrame, scope: str = "shortlisted candidates") -> DataFrame:
    """job_id, candidate_id, insight: a paragraph for each job's first candidate, set against the second where there is one.

    Only the first two of each job are scored and joined with their texts. Ties
    go by similarity, then to the smaller id.
    """
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("score"), F.desc("similarity"), "candidate_id"))
    top = rankings.select("job_id", "candidate_id", "score", "similarity", place.alias("place")).where(F.col("place") <= 2)
    why = ranking.explanations(top, jobs, candidates).select("job_id", "candidate_id", "skills_match_ratio", "experience_match", "education_match", F.size("missing_skills").alias("lacking"))
    person = candidates.select(
        "candidate_id", F.coalesce(F.nullif(text_of("full_name"), F.lit("")), F.col("candidate_id").cast("string")).alias("name"), text_of("title").alias("own_title"), text_of("role_label").alias("role"),
        "years", text_of("degree").alias("degree"), first_certificate(text_of("certifications")).alias("certificate"), F.col("skills").alias("had"),
    )
    rows = top.select("job_id", "candidate_id", "score", "place").join(why, ["job_id", "candidate_id"]).join(person, "candidate_id")
    all_ = F.struct(*[c for c in rows.columns if c not in ("job_id", "place")])
    pairs = rows.groupBy("job_id").agg(F.max(F.when(F.col("place") == 1, all_)).alias("a"), F.max(F.when(F.col("place") == 2, all_)).alias("b")).where("a is not null")
    asked = jobs.select("job_id", F.coalesce(F.nullif(text_of("title"), F.lit("")), F.lit("this role")).alias("opening"), F.coalesce("skills", F.lit("")).alias("wanted"), F.col("min_experience").alias("least"))
    both = pairs.join(asked, "job_id")

    phrases = F.filter(F.transform(F.split("wanted", r"[,;\n]+"), trimmed), lambda p: p != "")
    shared = F.array_intersect(skills.parse_skills(F.col("wanted")), skills.parse_skills(F.col("a.had")))
    both = both.withColumns({"phrases": phrases, "shared": shared})
    named = F.slice(F.filter("phrases", lambda p: F.array_contains("shared", F.lower(p))), 1, MOST_NAMED)
    pool = "this shortlist" if "shortlist" in scope.lower() else "this ranking pool"
    a, b, opening, years = F.col("a.name"), F.col("b.name"), F.col("opening"), F.col("a.years")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    known = years.isNotNull() & ~F.isnan(years)
    enough = F.col("least").isNotNull() & (years + 1e-6 >= F.col("least"))
    headline = F.concat_ws(" / ", F.nullif(F.col("a.own_title"), F.lit("")), F.nullif(F.col("a.role"), F.lit("")))
    missing = lambda side: F.col(f"{side}.lacking").cast("string")
    # The sentences, in their order; one that does not apply is null and left out.
    sentences = [
        line(
            a, " is ranked #1 for ", opening, f" because their overall match score is highest among {scope} (", percent(F.col("a.score")), "%), with a ", strength(F.col("a.score")),
            " strength rating from the ranking model, supported by structured signals on skills coverage (", percent(F.col("a.skills_match_ratio")),
            "% of the job’s listed requirement tags found in their résumé skills), experience fit versus the role minimum (", percent(F.col("a.experience_match")), "%), and education alignment (", percent(F.col("a.education_match")), "%).",
        ),
        F.when(F.size("named") > 0, line("Concrete alignment shows up in overlapping requirement areas such as ", F.array_join("named", ", "), ", drawn directly from the job’s stated skills and their résumé.")).when(
            F.size("phrases") > 0,
            "Keyword-level tag overlap is not dominant in the parsed skills lists; the top rank is driven mainly by the full job description versus full résumé scoring, where this profile still separates from peers.",
        ),
        F.when(headline != "", line("Their headline profile (", headline, ") reinforces domain relevance for this opening.")),
        F.when(known & enough, line("They report about ", plain_number(years), " years of experience, meeting or exceeding the role’s stated minimum of ", plain_number(F.col("least")), " years, which supports depth expectations for delivery.")).when(
            known, line("They report about ", plain_number(years), " years of experience in the structured profile fields used for screening.")
        ),
        F.when(F.col("a.degree") != "", line("Education signals include ", F.replace(F.col("a.degree"), F.lit("_"), F.lit(" ")), " as the recorded highest degree.")),
        F.when(F.col("a.certificate") != "", line("Certifications/credentials on file include: ", F.col("a.certificate"))),
        F.when(
            F.col("b").isNotNull(),
            line(
                "Compared with ", b, " at rank #2 (match score ", percent(F.col("b.score")), "%, tagged skills coverage ", percent(F.col("b.skills_match_ratio")), "%), ", a,
                " leads on the model score gap and shows fewer uncovered requirement tags in the parsed job-versus-résumé view (", missing("a"), " missing vs ", missing("b"), " for #2), which is consistent with placing them ahead for this requisition.",
            ),
        ),
        line(
            "Overall, ", a, f" combines the strongest automated match score with the most favorable structured overlap and experience/education signals in {pool}, so they are positioned as the highest-impact choice for advancing ", opening, ".",
        ),
    ]
    return both.withColumn("named", named).select("job_id", F.col("a.candidate_id").alias("candidate_id"), F.concat_ws(" ", *sentences).alias("insight"))


def still_shortlisted(rankings: DataFrame, shortlist: DataFrame) -> DataFrame:
    """The ranked pairs that are on their job's shortlist, and all pairs of jobs that have none."""
    listed = shortlist.select("job_id", "candidate_id").distinct()
    marked = rankings.join(listed.withColumn("on_list", F.lit(True)), ["job_id", "candidate_id"], "left")
    marked = marked.join(listed.select("job_id").distinct().withColumn("has_list", F.lit(True)), "job_id", "left")
    return marked.where(F.col("on_list").isNotNull() | F.col("has_list").isNull()).select(*rankings.columns)


def insight_keys(rankings: DataFrame) -> DataFrame:
    """job_id, insight_key: a digest of who is ranked for a job and of its last run, which changes when either does.

    The candidates enter by the sum of their own digests, so that no job's
    candidates are gathered in one place. Each pair is in rankings once.
    """
    part = F.conv(F.substring(F.md5(F.col("candidate_id").cast("string")), 1, 12), 16, 10).cast("decimal(38,0)")
    one = rankings.groupBy("job_id").agg(F.count(F.lit(1)).cast("string").alias("n"), F.sum(part).cast("string").alias("ids"), F.unix_timestamp(F.max("run_at")).cast("string").alias("last"))
    return one.select("job_id", F.sha2(F.concat_ws("|", "n", "ids", "last"), 256).alias("insight_key"))
