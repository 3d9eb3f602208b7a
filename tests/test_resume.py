"""Résumé texts, skill phrases and titles: hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.functions import matching as m
from crestline.functions import resume as cv
from crestline.operators import matching, resume
from crestline.sources.spread import spread


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


YEARS = [
    (None, 0.0),
    ("", 0.0),
    ("Engineer with 12 years of experience in software", 12.0),
    ("Over 4 years at university", 0.0),
    ("13 years related to your experience with ads", 0.0),
    ("I have 5 years in the industry and 2.5 years of experience", 5.0),
    ("99 years of experience", 0.0),
    ("Work Experience\nDeveloper\n2010 - 2014\n2012 to 2016\nEducation\nState University 2000 - 2004", 6.0),
    ("Work Experience\nJan 2015 - Mar 2018\n03/2017 - 06/2019", 4.4),
    ("EXPERIENCE\nDesigner 2016/02 - present", 4.8),
    ("Education\nUniversity 2004 - 2008", 0.0),
    ("Engineer, Acme Ltd, 2 0 0 5 - 2 0 0 9", 4.0),
    ("Projects\nShop 2001 - 2020", 5.0),
    ("Projects\nShop 2001 - 2003\nSkills\nArt 2004 - 2020", 2.0),
    ("Work experience\nDeveloper 1980 - 2020", 40.0),
    ("Work experience\nDeveloper 2018 - 2015", 0.0),
]


def test_years_of_experience(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(YEARS)], "id int, text string")
    got = by_id(resume.years_experience(df, 2020), "years")
    assert got == {i: want for i, (_, want) in enumerate(YEARS)}


EMAILS = [
    (None, ""),
    ("", ""),
    ("no address here", ""),
    ("write to no-reply@firm.com or Ann.Lee@Firm.com", "ann.lee@firm.com"),
    ("x@y.org first\nE-mail: me@own.net", "me@own.net"),
    ("jane [at] host [dot] io", "jane@host.io"),
    ("zed99gmail.com", "zed99@gmail.com"),
    ("mailto:a.b@c.co and d@example.com", "a.b@c.co"),
    ("x" * 13_000 + " late@page.org", "late@page.org"),
    ("Ann Lee\nann lee 22 g mail c o m\nsql", "annlee22@gmail.com"),
    ("me h o t m a i l . c o m", "me@hotmail.com"),
    ("Bo Chan\nbo77@web\n.net\nSkills\nsql", "bo77@web.net"),
    ("Cy Ray\ncyray5\ngmail.com\nEducation\nMSc", "cyray5@gmail.com"),
    ("Cy Ray\nSkills\ncyray5\ngmail.com", ""),
    ("I read mail com ads\ngmail is a host", ""),
]


def test_primary_email(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EMAILS)], "id int, text string")
    assert by_id(resume.primary_email(df), "email") == {i: want for i, (_, want) in enumerate(EMAILS)}


def test_a_long_text_is_read_to_its_end(spark):
    text = "\n".join(["Skills: sql"] * 20_000 + ["Work experience", "Developer 2011 - 2015"])
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert by_id(resume.years_experience(df, 2020), "years") == {1: 4.0}


def test_sections_and_certificates(spark):
    text = F.lit("Education\nState College\nCertifications\nAWS Solutions Architect Associate\nScrum\nSkills\nsql\nCISSP\nScrum")
    items = cv.lines(text)
    assert value(spark, cv.section(items, cv.CERT_HEADING, ["certifications"])) == ["AWS Solutions Architect Associate", "Scrum"]
    assert value(spark, cv.section(items, cv.EDU_HEADING, ["education", "academic"])) == ["State College"]
    assert value(spark, cv.certifications(items)) == "AWS Solutions Architect Associate | Scrum | CISSP"
    assert value(spark, cv.certifications(cv.lines(F.lit(None).cast("string")))) == ""
    assert value(spark, F.size(cv.section(cv.lines(F.concat(F.lit("Certifications\n"), F.repeat(F.lit("a\n"), 40))), cv.CERT_HEADING, []))) == 24


@pytest.mark.parametrize(("text", "want"), [("MBA and BSc", "master"), ("Ph.D.", "phd"), ("A-Levels, SSC", "intermediate"), ("matric", "matric"), ("B.Sc", "bachelor"), ("none", ""), (None, "")])
def test_highest_degree(spark, text, want):
    assert value(spark, cv.highest_degree(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("short", "other"),
        ("A line that names no one", "header"),
        ("Skills\npython and sql\n12 endorsements", "skills"),
        ("State University, Bachelor of Arts, GPA 3.9\ngraduated", "education"),
        ("Certified in the cloud\nlicense 12", "certifications"),
        ("Developer at Acme, full-time, 2016 - present\nbuilt things", "experience"),
        ("Overview: I enjoy work\nLead at Bolt, contract, 2016 - 2019", "experience"),
        ("no sign at all\nin two lines", "other"),
    ],
)
def test_chunk_role(spark, text, want):
    assert value(spark, cv.chunk_role(F.lit(text))) == want


def test_chunks(spark):
    text = F.lit("A first paragraph here\r\n\r\nshort\n\nSecond one, long enough\nMarch 2019 and what was done")
    assert value(spark, cv.chunks(text)) == ["A first paragraph here", "Second one, long enough", "March 2019 and what was done"]
    assert value(spark, cv.chunks(F.lit(None).cast("string"))) == []


def test_lines_without_personal_data(spark):
    assert value(spark, cv.strip_pii_lines(F.lit("Ann  a@b.org\r\n  see www.x.org now"))) == "Ann [EMAIL]\nsee [URL] now"
    assert value(spark, cv.strip_pii_lines(F.lit(" \n"))) == " \n"


def test_skill_phrases_and_their_spellings(spark):
    assert value(spark, m.phrases(F.lit("• Tensor Flow; na | - SQL., \n k8s"))) == ["tensor flow", "sql", "k8s"]
    wanted, have = m.spelled(m.phrases(F.lit("tensorflow, scikit-learn, rust"))), m.bag(m.phrases(F.lit("TF, sklearn; feature engineering")))
    assert value(spark, m.alias_overlap(wanted, have)) == pytest.approx(2 / 3)
    assert value(spark, F.array_contains(have, "engineering"))
    assert value(spark, m.alias_overlap(m.spelled(m.phrases(F.lit(None).cast("string"))), have)) == 0.0
    assert value(spark, m.flat_overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5


@pytest.mark.parametrize(
    ("job", "title", "label", "want"),
    [("Backend Engineer", "Senior Backend Developer", None, True), ("Backend Engineer", "Frontend Developer", "", False), ("Engineer", "Nurse", "", True), ("", "x", "y", True), ("Home", "Nurse", "", True), ("Data Analyst", "Engineer", "data", True), (None, None, None, True)],
)
def test_title_guard(spark, job, title, label, want):
    assert value(spark, m.title_guard(*[F.lit(x).cast("string") for x in (job, title, label)])) is want


def test_titles_labels_departments(spark):
    assert value(spark, m.clean_title(F.lit("Senior QA/Test Engineer @ Acme Ltd"))) == "senior qa/test engineer acme"
    assert value(spark, m.clean_title(F.lit("energetic engineer"))) == "unknown"
    assert value(spark, m.clean_title(F.lit("Acme Ltd"))) == "unknown"
    assert value(spark, m.role_label(F.lit(" Data Analyst "))) == "data"
    assert value(spark, m.role_label(F.lit(None).cast("string"))) == "other"
    assert value(spark, m.department(F.lit("Accountant"), F.lit("audit of the ledger"))) == "finance"
    assert value(spark, m.department(F.lit("Accountant"), F.lit("audit"), F.array(F.lit("figma")), {"design": ["figma"]})) == "design"
    assert value(spark, m.department(F.lit("x"), F.lit(None).cast("string"))) == "general"
    assert value(spark, m.core_skill(F.lit("c++"))) and not value(spark, m.core_skill(F.lit("front-end"))) and not value(spark, m.core_skill(F.lit("cooking")))
    assert value(spark, m.fallback_score(F.lit(None).cast("double"), F.lit("a, b,"), F.lit(""), F.lit(" "))) == 3
    assert value(spark, m.fallback_score(F.lit(30.0), F.lit("a"), F.lit("x"), F.lit("y"))) == 92


def test_smart_filter(spark):
    jobs = spark.createDataFrame([(1, "Backend Engineer", "python, k8s, sql"), (2, "Chef", None)], "job_id int, title string, skills string")
    people = spark.createDataFrame([(1, "Backend Dev", "", "python"), (2, "API Engineer", "", "python"), (3, "Designer", "", "python, kubernetes"), (4, "API Engineer", "", "Python; kubernetes")], "candidate_id int, title string, role_label string, skills string")
    pairs = jobs.select("job_id").crossJoin(people.select("candidate_id")).withColumn("similarity", F.when(F.col("candidate_id") == 1, 0.05).otherwise(0.9))
    got = {tuple(r) for r in matching.smart_filter(pairs, jobs, people, 0.05, 0.3).select("job_id", "candidate_id").collect()}
    # One skill of three needs the title as well, two don't; a designer is turned down; a job without skills and with an unknown role takes all.
    assert got == {(1, 1), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4)}
    low = matching.low_matches(spark.createDataFrame([(1, 0.9, 0.1), (2, None, 0.1), (2, None, None)], "job_id int, score double, similarity double"), 0.5)
    assert [tuple(r) for r in low.collect()] == [(2, 2)]


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df).count() == 100
    assert spread(df, most_bytes=1) is df
    assert spread(spark.range(3)).count() == 3


#: Pieces of texts that repairs join in all kinds of ways.
SCRAPS = ["ann", "b", ".", " . ", "@", " @ ", "[at]", "( at )", " dot ", "[dot]", "com", "c o m", "g mail", "gmail.com", "y a h o o", "55", ",", "; ", "\n", "\r\n", " ", "  ", "e-mail:", "mailto:", "web.net", "no-reply", "\u200b", "\u00e9", "x|y", "host.io", "Skills", "'"]


def test_addresses_near_anchors(spark):
    """What is far from an at sign or a public host is not repaired: the rest gives the same addresses."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    both = df.select("text", cv.addresses(cv.scannable(F.col("text"))).alias("whole"), cv.addresses(cv.scannable(cv.near_anchors(F.col("text")))).alias("near")).collect()
    assert sum(len(x["whole"]) > 0 for x in both) > 100
    assert not [x for x in both if x["whole"] != x["near"]][:3]
    prose = "No one writes to the commander, said the old man. " * 40
    kept = spark.createDataFrame([(prose + "Ask ann [at] web.net, he said. " + prose,), (prose,), (None,)], "text string").select(cv.near_anchors(F.col("text")).alias("near")).collect()
    assert [x["near"] for x in kept] == [", said the old man. Ask ann [at] web.net", "", ""]
