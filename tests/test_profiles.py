"""Dates of profile rows, shortlists with counters and by hand, pools as shown, preferred rankings."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crestline.functions import dates
from crestline.operators import listing, matching, profile_rows, shortlisting

NOW = datetime(2024, 6, 15)


def test_months_ranges_and_keys_by_hand(spark):
    rows = {
        "Jan 2015 – Mar 2018": ((24180, 24218), 38, "jan 2015 - mar 2018"),
        "2010-2014": ((24120, 24168), 48, "2010-2014"),
        "September, 2020 — Present": ((24248, 24293), 45, "september, 2020 - present"),
        "Jan 2020 - Mar 2018": (None, 0, "jan 2020 - mar 2018"),
        "3 yrs 2 mos": (None, 38, "3 yrs 2 mos"),
        "2 Yrs": (None, 24, "2 yrs"),
        "Foo 2019 -  2021": ((24228, 24252), 24, "foo 2019 - 2021"),
        "13 years related 2001-2004": ((24012, 24048), 0, "13 years related 2001-2004"),
        "full-time": (None, 0, "full-time"),
        "": (None, 0, ""),
        " \n": (None, 0, ""),
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    got = {r["t"]: (r["span"] and tuple(r["span"]), r["m"], r["k"]) for r in df.select("t", dates.month_range(F.col("t"), F.lit(NOW)).alias("span"), dates.months(F.col("t"), F.lit(NOW)).alias("m"), dates.dates_key(F.col("t")).alias("k")).collect()}
    assert got == rows
    none = spark.createDataFrame([(None,)], "t string").select(dates.month_range(F.col("t"), F.lit(NOW)), dates.months(F.col("t"), F.lit(NOW)), dates.dates_key(F.col("t"))).first()
    assert tuple(none) == (None, 0, "")


def test_rows_of_schools_are_told_by_dates_and_words(spark):
    jobs = [(1, "Jan 2015 – Mar 2018", "a"), (1, "2015-2018", "b"), (1, "2010 — 2012", "c"), (1, None, "d"), (1, "", "e"), (2, "2015-2018", "f"), (None, "2015-2018", "g"), (1, "Part time", "h")]
    schools = [(1, "January 2015 - March 2018"), (1, "2010 - 2012"), (1, ""), (1, None), (None, "2015-2018"), (3, "2015-2018"), (1, "part  TIME")]
    kept = profile_rows.jobs_alone(spark.createDataFrame(jobs, "person long, dates string, _key string"), spark.createDataFrame(schools, "person long, dates string"), F.lit(NOW))
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["dates"] or "" for r in kept.collect()) == ["", "", "2015-2018", "2015-2018", "2015-2018"]
    said = [("PhD student", "Acme", None, False), ("Student", "University of X", "", True), ("MSc", "Lahore College", "", True), ("Bachelor's degree", "", "", True), ("Teacher", "High School", "", False), ("Clerk", None, "Grade: A", True), ("M.Phil", "Polytechnic", "", True), (None, None, None, False)]
    df = spark.createDataFrame(said, "role string, company string, text string, want boolean")
    assert df.where(dates.is_study(F.col("role"), F.col("company"), F.col("text")) != F.col("want")).count() == 0


def test_counters_are_those_of_separate_counts(spark):
    rng = random.Random(2)
    jobs = spark.createDataFrame([(j, rng.choice(["python, sql", "react", ""]), rng.choice(["Data Analyst", "Frontend Developer"])) for j in range(8)], "job_id long, skills string, title string")
    people = spark.createDataFrame([(c, rng.choice(["python", "sql; react", ""]), rng.choice(["Data Analyst", "Chef", "Frontend Engineer"]), "") for c in range(50)], "candidate_id long, skills string, title string, role_label string")
    pairs = spark.createDataFrame([(j, c, rng.choice([None, 0.01, 0.3, 0.7, 0.9])) for j in range(8) for c in rng.sample(range(50), 30)], "job_id long, candidate_id long, similarity double")
    applied = spark.createDataFrame([(j, c) for j in range(9) for c in rng.sample(range(50), 4)] * 2, "job_id long, candidate_id long")
    found, counts = shortlisting.refreshed_shortlist(pairs, jobs, people, applied, 0.05, 0.2, 3)
    passed = matching.smart_filter(pairs, jobs, people, 0.05, 0.2).count()
    with_similarity = pairs.where("similarity is not null").count()
    rows = found.collect()
    forced = [r for r in rows if r["forced"]]
    assert counts == {"pool": 240, "with_similarity": with_similarity, "passed": passed, "forced": len(forced), "filtered_out": with_similarity - passed}
    assert {(r["job_id"], r["candidate_id"]) for r in applied.collect()} <= {(r["job_id"], r["candidate_id"]) for r in rows} and len(forced) >= 4
    places = {}
    for r in sorted(rows, key=lambda r: (r["job_id"], r["place"])):
        places.setdefault(r["job_id"], []).append((r["forced"], -r["similarity"], r["candidate_id"]))
    assert all(p == sorted(p) and sum(not f for f, *_ in p) <= 3 for p in places.values())
    none, zero = shortlisting.refreshed_shortlist(pairs.where("false"), jobs, people, applied.where("false"), 0.05, 0.2, 3)
    assert none.count() == 0 and set(zero.values()) == {0}


def test_a_shortlist_is_changed_by_hand(spark):
    frame = lambda rows, schema="job_id long, candidate_id long": spark.createDataFrame(rows, schema)
    people = frame([(1, "new"), (2, None), (3, "hired"), (4, "screened"), (5, "new")], "candidate_id long, status string")
    applied = frame([(7, 1, "new"), (7, 2, "interviewing"), (7, 4, None), (8, 5, "new")], "job_id long, candidate_id long, status string")
    listed, after, cands = shortlisting.changed_shortlist(frame([(7, 5), (7, 1), (8, 5)]), applied, people, frame([(7, 1), (7, 2), (7, 3), (7, 4), (7, 99), (7, None), (7, 2)]), frame([(7, 5), (7, 1), (9, 9)]))
    assert sorted(map(tuple, listed.collect())) == [(7, 1), (7, 2), (7, 3), (7, 4), (8, 5)]
    assert sorted(map(tuple, after.collect())) == [(7, 1, "shortlisted"), (7, 2, "interviewing"), (7, 3, "shortlisted"), (7, 4, "shortlisted"), (8, 5, "new")]
    assert sorted(map(tuple, cands.collect())) == [(1, "shortlisted"), (2, "shortlisted"), (3, "hired"), (4, "shortlisted"), (5, "new")]
    # What is on the list already is not lifted again.
    _, same, _ = shortlisting.changed_shortlist(frame([(7, 1)]), applied, people, frame([(7, 1)]), frame([]))
    assert (7, 1, "new") in set(map(tuple, same.collect()))


def test_a_pool_as_shown(spark):
    pool = spark.createDataFrame([(1, "bo", "Dev", None, "sql", True, 0.5), (2, "Al", "Dev", "x", "", False, 0.9), (3, "cy", None, None, "java dev", None, None), (4, "Di", "Chef", "", "", True, 0.7), (1, "bo", "Dev", None, "sql", True, 0.5)], "candidate_id long, name string, title string, role string, skills string, is_public boolean, similarity double")
    ranked = spark.createDataFrame([(1, 2, 0.594), (2, 1, 0.8), (4, 3, None)], "candidate_id long, rank int, score double")
    ids = lambda *a, **k: [r["candidate_id"] for r in shortlisting.shown_pool(pool, *a, **k).orderBy("place").collect()]
    none = ranked.where("false")
    assert ids(none, "name_asc", 2) == [2, 1, 3, 4] and ids(none, "score_desc", 2, only_top=True) == [2, 4] and ids(none, "rank_asc", 9) == [2, 4, 1, 3]
    assert ids(ranked, "rank_asc", 9) == [2, 1, 4] and ids(ranked, "match_desc", 2) == [2, 1] and ids(ranked, "score_desc", 9) == [2, 1, 4]
    assert ids(ranked, "match_desc", 9, least_percent=59) == [2, 1] and ids(ranked, "match_desc", 9, least_percent=60) == [2]
    assert ids(none, "name_asc", 9, audience="public") == [1, 4] and ids(none, "name_asc", 9, audience="private") == [2, 3] and ids(none, "name_asc", 9, "  DEV ") == [2, 1, 3]
    with pytest.raises(ValueError, match="sort is one of"):
        ids(none, "best", 1)


def test_the_own_workspace_comes_before_a_better_score(spark):
    applied = spark.createDataFrame([(1, 5, " new "), (2, 5, None), (3, 5, "hired")], "job_id long, candidate_id long, status string")
    jobs = spark.createDataFrame([(1, " A ", 10, 7), (2, "B", None, None), (3, "C", 11, 7)], "job_id long, title string, client_id long, workspace_id int")
    clients = spark.createDataFrame([(10, "ann", ""), (11, "bo", " Firm ")], "client_id long, name string, company_name string")
    ranked = spark.createDataFrame([(1, 5, 7, 0.4), (1, 5, 8, 0.9), (1, 5, 7, 0.41), (2, 5, None, 0.2), (2, 5, 8, 0.3), (3, 6, 7, 0.5)], "job_id long, candidate_id long, workspace_id int, score double")
    got = {r["job_id"]: tuple(r)[2:] for r in listing.application_scores(applied, jobs, clients, ranked).collect()}
    assert got == {1: ("A", "ann", "new", 41.0, True), 2: ("B", "", "new", 30.0, False), 3: ("C", "Firm", "hired", None, None)}


def test_a_date_is_cut_and_searched_once(spark):
    df = spark.createDataFrame([("Jan 2015 - 2018", "PhD student", "Ulm College")], "t string, role string, company string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().lower()
    for c in (dates.month_range(F.col("t"), F.lit(NOW)), dates.months(F.col("t"), F.lit(NOW))):
        assert plan(c).count("split(") == 1, plan(c)
    assert plan(dates.is_study(F.col("role"), F.col("company"), F.lit(""))).count("concat_ws(") == 1
