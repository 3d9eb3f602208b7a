"""Lines of pasted pages, by hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from crestline.operators import resume, retrieval

CASES = [
    # An ordinary résumé keeps names, brands and chips; menus, adverts and places of work go anywhere.
    ("Ann Lee\nFigma\nIBM\nAccessibility.\n\nCareers in sql", "Ann Lee\nFigma\nIBM\n\nCareers in sql"),
    ("python · On-site\nOn-site\nlead (on-site)", ""),
    ("x" * 120 + " (on-site)", "x" * 120 + " (on-site)"),
    ("Please let us know\nTools: and many more\nsql and many more\nOur Clients include Acme", "Tools: and many more"),
    # A pasted page loses them.
    ("People also viewed\nAnn Lee\nJ Smith\nFigma (Software)\nUser Experience  Design (UED).\nACME!\nSkills: Figma\nBoom! now\nBuilt high conversion pages\nAnn Maria Lee", "Skills: Figma\nAnn Maria Lee"),
    ("Ad choices here\ndon’t want to see this?\nIBM\nsql", "Ad choices here\nsql"),
    ("one\r\ntwo  \n\nthree\n\n", "one\ntwo\n\nthree\n"),
    (" \n", " \n"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    return {r["id"]: r["clean"] for r in resume.without_page_chrome(spark.createDataFrame(rows, "id int, text string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_lines(cleaned, i):
    assert cleaned[i] == CASES[i][1]


def test_known_words(spark):
    docs = spark.createDataFrame([(1, "Spark sql Spark no"), (2, None), (3, "zz"), (4, "rust, sql; awk")], "id int, text string")
    known = spark.createDataFrame([("sql",), ("spark",), ("awk",), ("rust",)], "word string")
    got = {r["id"]: r["words"] for r in retrieval.known_words(docs, known, 2).collect()}
    assert got == {1: ["spark", "sql"], 2: [], 3: [], 4: ["awk", "rust"]}
    assert all(r["words"] == [] for r in retrieval.known_words(docs, known.where(F.lit(False)), 2).collect())
