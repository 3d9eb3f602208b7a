"""Education lines: hand-worked cases of merging, leaks, scraps and skills that run on."""

import pytest
from pyspark.sql import functions as F

from crestline.functions import education as ed
from crestline.operators import resume

STACK = "● JavaScript (ES6+), TypeScript, Python | ● React.js, Node.js | Web Technologies | ● HTML5, CSS"
WRONG_DASH = "–".encode().decode("cp1252")
TEXTS = [
    (f"\nEDUCATION\nNorth University — Bachelor of Science in Computer Science | 2022 – 2026 | Technical Skills | Programming & Development | {STACK}\n", "North University — Bachelor of Science in Computer Science | 2022 – 2026"),
    ("\nEDUCATION\nNorth University — BS Computer Science | 2022 – 2026 |\u200b Technical Skills |\u200b ● JavaScript, Python\n", "North University — BS Computer Science | 2022 – 2026"),
    ("\nEDUCATION\nNorth University — Bachelor of Science 2022 – 2026 Technical Skills JavaScript, React\n", "North University — Bachelor of Science 2022 – 2026"),
    ("Education\nBachelor of Science\nNorth University\nSkills\npython\n", "North University — Bachelor of Science"),
    ("Education\nNorth University\nMaster of Arts\nSouth College\nDiploma in law\nCertifications\nCISSP\n", "North University — Master of Arts | South College — Diploma in law"),
    ("Education\nNorth University, BSc\nSouth College, MSc\n", "North University, BSc | South College, MSc"),
    (
        f"Education\nBS-AI, Artificial Intelligence degree\nJun 2023{WRONG_DASH}Nov 2023\nGrade: pass\nActivities and societies: Football\n"
        "Hello there, I underwent a long training program in data science and now I am a student of the arts at a place far away from here.\n"
        f"Computer Vision, Data Visualization and +9 skills\nNorth University\nFeb 2024{WRONG_DASH}Present\nActivities and societies: coding\nsports\n",
        "North University — BS-AI, Artificial Intelligence degree",
    ),
    ("Engineer at Acme\nNorth University 2010\nlived near South School, Projects: many\n", "North University 2010 | lived near South School, Projects: many"),
    ("Education\nNorth University 2010\nSkills\nart\nSouth School, Projects: many\nWest College 2004\n", "North University 2010 | West College 2004"),
    ("Work at Acme\nnothing else", ""),
    ("", ""),
    (None, ""),
    ("a b c school " + "x" * 100_000, ""),
]


def test_education_of_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id int, text string")
    got = {r["id"]: r["education"] for r in resume.education(df).collect()}
    wrong = [(t, got[i], want) for i, (t, want) in enumerate(TEXTS) if got[i] != want]
    assert not wrong


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "Education\nNorth University", "x")] * 2, "id int, text string, lines string")
    got = resume.education(df)
    assert got.columns == ["id", "text", "lines", "education"]
    assert [tuple(r)[2:] for r in got.collect()] == [("x", "North University")] * 2
    assert resume.education(df.limit(0)).count() == 0


def array(*items):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


LONG = "North University " + "word " * 60
CASES = [
    (lambda: ed.merged(array("BSc physics", "North University", "South College")), ["North University — BSc physics", "South College"]),
    (lambda: ed.merged(array("North University", "South College", "MBA")), ["North University", "South College — MBA"]),
    (lambda: ed.merged(array("MBA", "BSc", "minor")), ["MBA", "BSc", "minor"]),
    (lambda: ed.merged(array("one")), ["one"]),
    (lambda: ed.merged(array()), []),
    (lambda: ed.refined(array("North University " + "and more " * 9 + "projects", "North University", "North  University", "Grade: pass")), ["North University"]),
    (lambda: ed.refined(array(*[f"School {i}" for i in range(12)])), [f"School {i}" for i in range(8)]),
    (lambda: ed.pieces(F.lit("first degree 2010 • second degree 2012; third one " + "x" * 200)), ["first degree 2010", "second degree 2012", "third one…"]),
    (lambda: ed.scrubbed(F.lit("x oe University of North | 2010 | ab cd ef gh | London")), "University of North | 2010 | London"),
    (lambda: ed.scrubbed(F.lit("x oe North University | 2010")), "x oe North University | 2010"),
    (lambda: ed.scrubbed(F.lit("ab cd | ef gh")), "ab cd | ef gh"),
    (lambda: ed.scrubbed(F.lit("the old war City College | 2001")), "College | 2001"),
    (lambda: ed.scrubbed(F.lit("North University | technical skills | South College")), "North University"),
    (lambda: ed.without_scraps(F.lit("North University ab c de fg hi")), "North University"),
    (lambda: ed.without_scraps(F.lit("North University department of applied physics")), "North University department of applied physics"),
    (lambda: ed.without_skills(F.lit("BSc 2026 · ● Python, React")), "BSc 2026"),
    (lambda: ed.without_skills(F.lit("MIT / Soft skills: chess")), "MIT"),
    (lambda: ed.finished(array()), ""),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_steps(spark, at):
    column, want = CASES[at]
    assert spark.range(1).select(column().alias("x")).first()["x"] == want
