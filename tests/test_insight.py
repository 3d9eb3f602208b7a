"""Explanations and insights by hand-worked cases."""

from pyspark.sql import functions as F

from crestline.operators import insight, ranking


def tables(spark):
    jobs = spark.createDataFrame([(1, "Backend Engineer", "Python, kafka; Excel", 4.0, "masters"), (2, " ", "", None, "any")], "job_id int, title string, skills string, min_experience double, education_required string")
    people = [(1, "Ann Lee", "Engineer", "backend", "python, excel", 2.5, "bachelors", "PMP | CSM"), (2, "Bo", "", "", "java", 9.0, "masters", ""), (3, "", None, None, None, None, None, None)]
    candidates = spark.createDataFrame(people, "candidate_id int, full_name string, title string, role_label string, skills string, years double, degree string, certifications string")
    rankings = spark.createDataFrame([(1, 1, 0.8, 0.5), (1, 2, 0.6, 0.5), (1, 3, 0.1, 0.5), (2, 3, 0.125, 0.0)], "job_id int, candidate_id int, score double, similarity double")
    return rankings, jobs, candidates


def test_explanation(spark):
    got = {(r["job_id"], r["candidate_id"]): r for r in ranking.explanations(*tables(spark)).collect()}
    ann = got[1, 1]
    assert ann["skills_match_ratio"] == 0.6667  # two of three, not a share of both lists
    assert ann["total_skill_coverage"] == 0.5556  # 1.25 of 2.25: excel weighs a quarter
    assert ann["critical_skill_coverage"] == 0.5
    assert ann["experience_match"] == 0.625  # 2.5 of 4 years
    assert ann["education_match"] == 0.0
    assert (ann["missing_skills"], ann["missing_critical_skills"]) == (["kafka"], ["kafka"])
    assert ann["score_raw"] == 0.8
    empty = got[2, 3]
    assert (empty["skills_match_ratio"], empty["experience_match"], empty["education_match"], empty["missing_skills"]) == (0.0, 0.5, 0.5, [])


def test_insight_of_two_and_of_one(spark):
    got = {r["job_id"]: (r["candidate_id"], r["insight"]) for r in insight.top_insight(*tables(spark)).collect()}
    who, said = got[1]
    assert who == 1
    assert said.startswith("Ann Lee is ranked #1 for Backend Engineer because their overall match score is highest among shortlisted candidates (80%), with a high strength")
    assert "areas such as Python, Excel, drawn" in said
    assert "(Engineer / backend)" in said
    assert "about 2.5 years of experience in the structured profile" in said
    assert "on file include: PMP Compared with Bo at rank #2 (match score 60%, tagged skills coverage 0%)" in said
    assert "(1 missing vs 3 for #2)" in said
    who, said = got[2]
    assert who == 3
    assert said.startswith("3 is ranked #1 for this role") and "(12%), with a low" in said
    assert "Compared" not in said and "They report" not in said and "Keyword-level" not in said


def test_shortlist_and_key(spark):
    rankings, _, _ = tables(spark)
    listed = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "job_id int, candidate_id int")
    pool = insight.still_shortlisted(rankings, listed)
    assert sorted((r["job_id"], r["candidate_id"]) for r in pool.collect()) == [(1, 2), (2, 3)]
    at = F.lit("2001-01-01").cast("timestamp")
    key = lambda df: {r["job_id"]: r["insight_key"] for r in insight.insight_keys(df).collect()}
    first, fewer, later = key(rankings.withColumn("run_at", at)), key(pool.withColumn("run_at", at)), key(rankings.withColumn("run_at", at + F.expr("INTERVAL 1 DAY")))
    assert first[1] != fewer[1] and first[2] == fewer[2] and first[2] != later[2]
