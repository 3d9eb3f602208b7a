"""The best of all candidates against a score of each pair by the scorer of single pairs."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import all_pairs, ranking

JOBS = "job_id long, skills string, min_experience double, education_required string"
PEOPLE = "candidate_id long, skills string, years double, degree string"


def tables(spark, seed, n_jobs, n_people):
    rng = random.Random(seed)
    names = ["python", "sql", "aws", "ec2", "react", "react native", "kafka", "message queues", "postgresql", "postgres", "c", "go", "excel", "rest", "rest apis", "node.js", "nodejs", "java", "javascript", "cicd", "ci", "docker", "figma", "é dia"]
    some = lambda most: rng.choice([", ", ";", " | "]).join(rng.sample(names, rng.randint(0, most))) if rng.random() < 0.95 else None
    jobs = [(i, some(6), rng.choice([None, 0.0, -1.0, 2.0, 3.5, 10.0]), rng.choice([None, "any", "bachelors", "phd", "masters"])) for i in range(n_jobs)]
    people = [(rng.randrange(10**6), some(7), rng.choice([None, 0.0, 1.0, 2.0, 2.5, 4.0, 12.0]), rng.choice([None, "", "Bachelors", "phd", "masters", "intermediate", "x"])) for _ in range(n_people)]
    return spark.createDataFrame(jobs, JOBS).repartition(3), spark.createDataFrame(people, PEOPLE).dropDuplicates(["candidate_id"]).repartition(3)


@pytest.mark.parametrize(("seed", "n_people", "k"), [(1, 150, 4), (2, 150, 1), (3, 6, 10)])
def test_best_are_those_of_all_pairs(spark, seed, n_people, k):
    jobs, people = tables(spark, seed, 60, n_people)
    pairs = jobs.select("job_id").crossJoin(people.select("candidate_id"))
    weak = {}
    for r in ranking.pair_scores(pairs, jobs, people).collect():
        weak.setdefault(r["job_id"], []).append((-round(r["weak"], 9), r["candidate_id"], round(r["skill"], 6), r["exp"], r["edu"]))
    want = {j: sorted(rows)[:k] for j, rows in weak.items()}
    got = {}
    for r in sorted(all_pairs.best_candidates(jobs, people, k).collect(), key=lambda r: r["place"]):
        got.setdefault(r["job_id"], []).append((-r["weak"], r["candidate_id"], round(r["skill"], 6), r["exp"], r["edu"]))
    assert got == want
    means = {r["candidate_id"]: r["mean_score"] for r in all_pairs.mean_scores(jobs, people).collect()}
    sums = {}
    for rows in weak.values():
        for w, c, *_ in rows:
            sums[c] = sums.get(c, 0) - w / len(weak)
    assert means == {c: pytest.approx(v, abs=2e-6) for c, v in sums.items()}
    assert all_pairs.best_candidates(jobs, people.where("false"), k).count() == 0 == all_pairs.best_candidates(jobs.where("false"), people, k).count()
    assert all_pairs.mean_scores(jobs.where("false"), people).count() == 0


def test_nothing_is_paired_with_everything(spark):
    jobs, people = tables(spark, 4, 20, 50)
    plan = all_pairs._first(people, ["skills"], [F.asc("candidate_id")], 3)._jdf.queryExecution().executedPlan().toString()
    # A task passes on three rows of a group at most.
    assert "WindowGroupLimit" in plan and "Partial" in plan
    plan = all_pairs.token_matches(jobs.select(F.col("skills").alias("w")), people.select(F.col("skills").alias("e")))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
