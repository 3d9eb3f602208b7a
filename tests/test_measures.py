"""Measures of classifiers and rankers, percentiles and splits, by hand and by plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import ranking


def test_summary_and_matrix(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("a", None), ("b", "d")]
    df = spark.createDataFrame(rows, "truth string, predicted string")
    (got,) = ranking.classification_summary(df).collect()
    # a: p 1/2, r 1/2; b: p 2/3, r 2/3; c: 0, 0; d: 0, 0.
    assert (got["n"], got["accuracy"], got["micro_f1"]) == (6, 0.5, 0.5)
    assert got["macro_precision"] == got["macro_recall"] == got["macro_f1"] == pytest.approx((1 / 2 + 2 / 3) / 4, abs=5e-5)
    cells = {(r["truth"], r["predicted"]): r["n"] for r in ranking.confusion_matrix(df).collect()}
    assert len(cells) == 16 and cells["b", "b"] == 2 and cells["c", "a"] == 1 and cells["d", "d"] == 0 and sum(cells.values()) == 6
    assert tuple(ranking.classification_summary(df.where("false")).first()) == (0, None, None, None, None, None)


def test_spearman_and_percentiles_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(6)), float(rng.randrange(9))) for i in range(300)]

    def ranks(values):
        return [sum(x < v for x in values) + (sum(x == v for x in values) - 1) / 2 for v in values]

    t, p = ranks([r[1] for r in rows]), ranks([r[2] for r in rows])
    mt, mp = sum(t) / 300, sum(p) / 300
    want = sum((a - mt) * (b - mp) for a, b in zip(t, p, strict=True)) / (sum((a - mt) ** 2 for a in t) * sum((b - mp) ** 2 for b in p)) ** 0.5
    df = spark.createDataFrame(rows, "id int, truth double, predicted double").repartition(5)
    assert tuple(ranking.spearman(df).first()) == (300, pytest.approx(want, abs=5e-5))
    assert tuple(ranking.spearman(df.withColumn("truth", F.lit(1.0))).first()) == (300, None)
    got = {r["id"]: (r["truth_pct"], r["predicted_pct"]) for r in ranking.percentiles(df, ["truth", "predicted"]).collect()}
    assert all(got[i] == (pytest.approx(100 * a / 299), pytest.approx(100 * b / 299)) for i, (a, b) in enumerate(zip(t, p, strict=True)))
    assert ranking.percentiles(df.where("id = 0"), ["truth"]).first()["truth_pct"] == 50.0
    # No task gets a column's values: ranges are exchanged, never one partition.
    assert "SinglePartition" not in ranking.mean_ranks(df, ["truth"])[0]._jdf.queryExecution().executedPlan().toString()


def test_stratified_split(spark):
    df = spark.range(1000).selectExpr("id", "case when id < 700 then 'hot' when id < 707 then null else 'rest' end as kind").repartition(4)
    split = ranking.split_stratified(df, "id", "kind")
    counts = {(r["kind"], r["split"]): r["count"] for r in split.groupBy("kind", "split").count().collect()}
    assert counts == {("hot", "train"): 560, ("hot", "val"): 70, ("hot", "test"): 70, (None, "train"): 5, (None, "val"): 1, (None, "test"): 1, ("rest", "train"): 234, ("rest", "val"): 29, ("rest", "test"): 30}
    again = ranking.split_stratified(df.repartition(7), "id", "kind")
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_new_scores_become_rows_behind_the_counts(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.5), (1, None), (2, 0.9)], "job_id long, score double")
    found = ranking.hypothetical_rank(df, [0.1, 0.5])
    assert sorted(map(tuple, found.collect())) == [(1, 0.1, 3, 3), (1, 0.5, 1, 3), (2, 0.1, 2, 1), (2, 0.5, 2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Generate") < plan.find("Aggregate")


def test_ranking_metrics_sort_a_querys_rows_three_times(spark):
    rows = [(1, 1, 0.9, 0.1), (1, 2, 0.4, 0.7), (1, 3, 0.6, 0.7), (2, 1, 0.5, 0.5), (2, 2, None, None), (3, 1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "query long, item long, truth double, predicted double")
    found = ranking.ranking_metrics(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("- Sort [") + plan.count(") Sort") == 3, plan
