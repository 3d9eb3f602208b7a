"""Operators and expressions on small tables: edges that the fixture tables do not hold."""

import datetime
import zlib

import pytest
from pyspark.sql import functions as F

from crestline.functions import scoring, skills, status, text
from crestline.operators import feeds, lexical, listing, ranking, retrieval
from crestline.sources import tables
from crestline.streaming import activity


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, []), ("", []), ("Python, python;  React/TypeScript", ["python", "react", "typescript"]), ("(Go) | C.", ["go", "c"]), ("a\nb", ["a", "b"])],
)
def test_parse_skills(spark, raw, want):
    assert value(spark, skills.parse_skills(F.lit(raw).cast("string"))) == want


def test_overlap_knows_synonyms(spark):
    wanted, have = skills.parse_skills(F.lit("kafka, aws, sql")), skills.parse_skills(F.lit("message queues, ec2"))
    assert value(spark, skills.overlap(wanted, skills.expand_each(wanted), skills.expand(have))) == pytest.approx(2 / 3)
    none = skills.parse_skills(F.lit(""))
    assert value(spark, skills.overlap(none, skills.expand_each(none), skills.expand(have))) == 0.0


@pytest.mark.parametrize(("years", "least", "want"), [(None, 2.0, 0.4), (2.0, 2.0, 1.0), (9.0, 2.0, 0.9), (1.0, 2.0, 0.7), (0.0, 2.0, 0.4), (3.0, None, 0.7)])
def test_experience_band(spark, years, least, want):
    number = lambda x: F.lit(x).cast("double")
    assert value(spark, scoring.experience_band(number(years), number(least), number(None))) == want


def test_status(spark):
    now, old = F.lit(datetime.datetime(2001, 9, 1)), F.lit(datetime.datetime(2001, 8, 25))
    assert value(spark, status.effective(F.lit(" NEW "), old, now)) == "screened"
    assert value(spark, status.effective(F.lit("new"), now, now)) == "new"
    assert value(spark, status.effective(F.lit("declined"), now, now)) == "rejected"


def test_pii(spark):
    assert value(spark, text.strip_pii(F.lit("write to a.b@c.org  or +1 555 123 4567, see www.x.org"))) == "write to [EMAIL] or [PHONE] , see [URL]"
    assert value(spark, text.strip_pii(F.lit(None).cast("string"))) == ""


def test_percentiles_of_one_and_of_ties(spark):
    pct = lambda xs: sorted(r["v_pct"] for r in ranking.percentiles(spark.createDataFrame([(x,) for x in xs], "v double"), ["v"]).collect())
    assert pct([3.0]) == [50.0]
    assert pct([1.0, 1.0, 1.0]) == [50.0] * 3
    assert pct([1.0, 2.0, 2.0]) == [0.0, 75.0, 75.0]


def test_interval_years(spark):
    rows = [("a", 2000, 2004), ("a", 2002, 2006), ("a", 2010, 2011), ("b", 2005, 2001), ("c", 1900, 1990), ("d", 2000, 2010), ("d", 2001, 2002), ("d", 2009, 2011)]
    got = {r["key"]: r["years"] for r in feeds.interval_years(spark.createDataFrame(rows, "key string, start int, end int")).collect()}
    assert got == {"a": 7, "c": 40, "d": 11}


def test_tfidf_leaves_out_what_shares_nothing(spark):
    queries = spark.createDataFrame([(1, "blue whale song")], "id long, text string")
    docs = spark.createDataFrame([(7, "blue whale song"), (8, "whale watching"), (9, "green tea"), (10, None)], "id long, text string")
    got = [(r["rank"], r["doc_id"]) for r in lexical.tfidf_top_k(queries, docs, 5).orderBy("rank").collect()]
    assert got == [(1, 7), (2, 8)]


def test_csv_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "k long, s string, x double")
    tables.write_csv(old, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), old.schema).collect())) == [(1, "a", None), (2, "b", 5.0)]
    new = spark.createDataFrame([(2, None, 6.0), (3, "c", None)], "k long, s string, x double")
    assert sorted(map(tuple, tables.upsert(old, new, "k").collect())) == [(1, "a", None), (2, "b", 6.0), (3, "c", None)]


def test_windows_are_alike_on_a_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, h), kind, float(h)) for d in (1, 2) for h in (1, 5) for kind in ("view", "click")]
    events = spark.createDataFrame(rows, "created_at timestamp, kind string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = activity.windowed_counts(activity.read_activity_stream(spark, str(tmp_path / "in"), events.schema))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, activity.windowed_counts(events).collect()))


def test_split_goes_by_the_id_alone(spark):
    ids = [*range(300), *range(0, 300, 3), None, None]
    rows = ranking.split_by_id(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, n long"), "id").collect()
    want = lambda i: "test" if i is None else [*["train"] * 8, "val", "test"][zlib.crc32(str(i).encode()) % 10]
    assert len(rows) == len(ids)
    assert all(r["split"] == want(r["id"]) for r in rows)
    assert {r["split"] for r in rows} == {"train", "val", "test"}


def test_overlap_looks_into_expanded_skills(spark):
    wanted, have = skills.parse_skills(F.lit("distributed, c\\go")), skills.parse_skills(F.lit("microservices"))
    assert value(spark, wanted) == ["distributed", "c", "go"]
    assert value(spark, skills.overlap(wanted, skills.expand_each(wanted), skills.expand(have))) == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("degree", "level"),
    [(None, 0.0), ("  ", 0.0), ("Ph. D", 5.0), ("MPhil", 4.5), ("M.Phil Physics", 4.5), ("MSc", 4.0), ("MBA", 4.0), ("BSc", 3.0), ("Bachelor of Arts", 3.0), ("diploma", 2.0), ("A-Level", 2.0), ("High  School", 1.0), ("something", 0.5)],
)
def test_education_ordinal(spark, degree, level):
    assert value(spark, ranking.education_ordinal(F.lit(degree).cast("string"))) == level


@pytest.mark.parametrize(("title", "boost"), [("Backend Engineer", 0.03), ("Full Stack Dev", 0.015), ("fullstack backend", 0.03), (None, 0.0), ("QA", 0.0)])
def test_title_boost(spark, title, boost):
    assert value(spark, ranking.title_boost(F.lit(title).cast("string"))) == boost


def test_feedback_labels_know_whole_words(spark):
    rows = [(1, i, action, 1) for i, action in enumerate(["hire", "Not a fit", "rejection", "hired_x", "shortlist_removed", "hired interest", "shortlist", None])]
    got = {r["candidate_id"]: r["label"] for r in feeds.latest_feedback(spark.createDataFrame(rows, "job_id int, candidate_id int, action string, created_at int")).collect()}
    assert got == {0: 1.0, 1: 0.0, 5: 1.0, 6: 0.85}


@pytest.mark.parametrize(("action", "want"), [(None, "new"), (" ", "new"), ("Not a fit", "rejected"), ("reject", "rejected"), ("Selected", "selected"), ("on hold!", "on_hold"), ("!!", "reviewed"), ("x" * 80, "x" * 64)])
def test_feedback_status(spark, action, want):
    assert value(spark, feeds.feedback_status(F.lit(action).cast("string"))) == want


def test_date_bounds_and_job_status(spark):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert listing.date_bound("2024-01-02T03:04:05") == when and listing.date_bound("2024-01-02T03:04:05.5") == when.replace(microsecond=500000)
    assert listing.date_bound("2024-01-02") == datetime.datetime(2024, 1, 2) and listing.date_bound("02.01.2024") is None and listing.date_bound(None) is None
    rows = [("on_hold", datetime.datetime(2024, 1, 1)), ("inactive", datetime.datetime(2024, 1, 3)), ("active", datetime.datetime(2024, 1, 2))]
    jobs = spark.createDataFrame(rows, "status string, created_at timestamp_ntz")
    assert sorted(r["status"] for r in listing.jobs_filtered(jobs, "On-Hold", "2024-01-01", "nothing").collect()) == ["inactive", "on_hold"]
    assert [r["status"] for r in listing.jobs_filtered(jobs, "inactive", None, "2024-01-01").collect()] == ["on_hold"]
    with pytest.raises(ValueError):
        listing.has_job_status(F.lit("x"), "unheard of")


@pytest.mark.parametrize(
    ("raw", "years"),
    [("3-5 years", 3), ("5 to 7 yrs", 5), ("minimum 2 years or 1 year", 2), ("at least 4+ years", 4), ("6+ years of experience, 2 years lead", 6), ("3 years java, 2 years sql", 2), ("none", None), (None, None)],
)
def test_years_asked(spark, raw, years):
    assert value(spark, text.years_asked(F.lit(raw).cast("string"))) == years


@pytest.mark.parametrize(
    ("title", "have", "role", "named"),
    [
        ("SQA Engineer", "python", "qa", "data scientist"), ("Engineer", "react, node.js", "fullstack", "full stack developer"), ("Engineer", "django", "backend", "backend developer"), ("X", "css", "frontend", "frontend developer"),
        ("Developer", "", "software", "unknown"), ("Analyst", "machine learning", "data", "data scientist"), ("X", "kotlin", "software", "unknown"), ("X", "selenium", "qa", "qa engineer"), ("X", "cooking", "other", "unknown"), ("", "", "unknown", "unknown"),
    ],
)
def test_roles(spark, title, have, role, named):
    assert value(spark, text.role_fine(F.lit(title), F.lit(have), F.lit(None).cast("string"))) == role
    assert value(spark, text.title_from_skills(F.lit(have))) == named


def test_resume_text(spark):
    raw = "  Skil-\nled in a-\nb-\n c\r\nx\x07y\n\n\n\n\nend \n"
    assert value(spark, text.resume_text(F.lit(raw))) == "Skilled in abc\nxy\n\n\nend"
    assert value(spark, text.resume_text(F.lit(None).cast("string"))) == ""
    assert value(spark, text.mended(F.lit("2019 â€“ 2020 itâ€™s"))) == "2019 – 2020 it’s"


def test_cosine_top_k_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, None), (103, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, retrieval.cosine_top_k(df, 10, 4).collect()))
    assert whole == sorted(map(tuple, retrieval.cosine_top_k(df, 10, 4, block=9, at_once=2).collect()))
    assert (100, 1, 101, 1.0) in whole and (20, 1, 41, 1.0) in whole


def test_pool_rank(spark):
    rows = [(i, i, float(i), "long enough " * 3 if i % 2 else "short") for i in range(80)]
    df = spark.createDataFrame(rows, "candidate_id int, created_at int, score double, text string")
    assert tuple(ranking.pool_rank(df, F.col("score"), 70.0, 60).first()) == (6, 30, True, 60)
    assert tuple(ranking.pool_rank(df.where("false"), F.col("score"), 70.0).first()) == (1, 0, False, 0)


def test_common_ngrams_cut_each_text_once(spark):
    docs = spark.createDataFrame([("B a-b a",), ("one",), ("",), (None,), ("a b",)], "text string")
    found = retrieval.common_ngrams(docs, {2: 2, 3: 9})
    assert sorted(map(tuple, found.collect())) == [(2, "a b", 2), (2, "b a", 2), (3, "a b a", 1), (3, "b a b", 1)]
    # The text is cut by one expression for each length, not once more for a filter or for a list of n-grams.
    plan = retrieval.common_ngrams(docs, {2: 2})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "transform(" not in plan
