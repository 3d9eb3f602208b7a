"""Backfills, exports, samples and the job board by hand-worked cases."""

from datetime import datetime

from crestline.operators import backfill


def test_workspace_from_the_first_link_that_knows_one(spark):
    candidates = spark.createDataFrame([(1, None), (2, None), (3, 9), (4, None), (5, None)], "candidate_id int, workspace_id int")
    jobs = spark.createDataFrame([(10, 7), (11, 8), (12, None)], "job_id int, workspace_id int")
    first = spark.createDataFrame([(12, 1), (11, 2), (10, 3), (12, 5)], "job_id int, candidate_id int")
    second = spark.createDataFrame([(11, 1), (10, 1), (10, 2)], "job_id int, candidate_id int")
    got = {r["candidate_id"]: r["workspace_id"] for r in backfill.workspace_backfill(candidates, [first, second], jobs).collect()}
    assert got == {1: 7, 2: 8}  # 3 has one, 4 has no link, 5 only a job of nobody


def test_best_job_of_a_workspace(spark):
    rankings = spark.createDataFrame([(10, 1, 0.5), (11, 1, 0.9), (12, 1, 0.5), (10, 2, None), (10, 3, 1.5)], "job_id int, candidate_id int, score double")
    jobs = spark.createDataFrame([(10, 7), (11, 8), (12, 7)], "job_id int, workspace_id int")
    got = {r["candidate_id"]: (r["best_job_id"], r["best_score"]) for r in backfill.workspace_best_jobs(rankings, jobs, 7).collect()}
    assert got == {1: (10, 50.0), 2: (10, 0.0), 3: (10, 100.0)}


def test_only_changes_are_returned(spark):
    rows = "candidate_id int, best_job_id int, best_score double"
    now = spark.createDataFrame([(1, 10, 50.0), (2, 10, 50.0), (3, 11, 50.0), (4, 10, 50.0), (5, None, 0.0)], rows)
    was = spark.createDataFrame([(1, 10, 50.005), (2, 10, 50.5), (3, 10, 50.0), (5, None, None)], rows)
    assert sorted(r["candidate_id"] for r in backfill.changed_best(now, was).collect()) == [2, 3, 4]


def test_export_keeps_rows_whose_job_is_gone(spark):
    given = spark.createDataFrame([(2, 1, 5, "hire", 0.5, "a\nb" + "c" * 600, datetime(2024, 1, 2)), (1, 9, 9, None, None, None, None)], "feedback_id int, job_id int, candidate_id int, action string, score double, notes string, created_at timestamp")
    jobs, people = spark.createDataFrame([(1,)], "job_id int"), spark.createDataFrame([(5,)], "candidate_id int")
    got = backfill.feedback_export(given, jobs, people).collect()
    assert [r["feedback_id"] for r in got] == [1, 2]
    assert tuple(got[0]) == (1, "", "", "", None, None, "")
    assert (got[1]["created_at"], got[1]["job"], got[1]["candidate"]) == ("2024-01-02T00:00:00", "1", "5")
    assert got[1]["notes"] == "a b" + "c" * 497


def test_sample_is_the_same_whatever_the_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g").union(spark.createDataFrame([(5000, None)], "id long, g long"))
    one = {tuple(r) for r in backfill.sample_by_group(df.repartition(1), "g", "id", 10).collect()}
    many = {tuple(r) for r in backfill.sample_by_group(df.repartition(7), "g", "id", 10).collect()}
    assert one == many and len(one) == 31
    assert "WindowGroupLimit" in backfill.sample_by_group(df, "g", "id", 10)._jdf.queryExecution().toString()


def test_job_board_marks_what_was_applied_for(spark):
    jobs = spark.createDataFrame(
        [(1, 1, "Engineer", "", "", "Active", 7, datetime(2024, 1, 1)), (2, 9, "Engineer", "", None, "active", 7, datetime(2024, 1, 2)), (3, 1, "Engineer", "", "", "on_hold", 7, datetime(2024, 1, 3)), (4, 1, "Engineer", "", "", "active", None, datetime(2024, 1, 3)), (5, 1, "Cook", None, "ENGINEERs eat", "active", 7, datetime(2024, 1, 1))],
        "job_id int, client_id int, title string, skills string, description string, status string, workspace_id int, created_at timestamp",
    )
    clients = spark.createDataFrame([(1, "Name", " ")], "client_id int, name string, company_name string")
    applied = spark.createDataFrame([(1, 11), (1, 11), (2, 12)], "job_id int, candidate_id int")
    got = {r["job_id"]: (r["firm"], r["total"], r["applied"]) for r in backfill.job_board(jobs, clients, applied, 11, "engineer", 0, 10).collect()}
    assert got == {1: ("Name", 3, True), 2: ("", 3, False), 5: ("Name", 3, False)}
