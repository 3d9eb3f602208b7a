"""Names from texts, addresses, file names and profile links: hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from crestline.functions import names as n
from crestline.operators import names

TEXTS = [
    ("M a r a   K l e i n\nData Engineer\nmara.klein@mail.org\n", "Mara Klein"),
    ("Full Name: Omar Siddiq\nQA Engineer\nLahore\n", "Omar Siddiq"),
    ("Finance Analyst Name: Hana Raza | City: Lahore\nA\nB\nC\nD\n", "Hana Raza"),
    ("Omar Siddiq | Senior QA Engineer | +92 300 0000000\nSummary line\n", "Omar Siddiq"),
    ("Senior Software Engineer | Lucia Moreno | lucia@email.com\n", "Lucia Moreno"),
    ("ROE, MARY\nSoftware Engineer\n", "Mary Roe"),
    ("OMAR SIDDIQ | QA Engineer | omar@email.com\n", "Omar Siddiq"),
    ("Senior Software Engineer | Peter Brown | Karachi, Pakistan | peter@email.com\nSummary\n", "Peter Brown"),
    ("Dr. Amina Shah\nConsultant\n", "Amina Shah"),
    ("Anne-Marie Dubois\nCaptain\n", "Anne-Marie Dubois"),
    ("Professional Summary\nSenior Backend Engineer with 5 years\nPeter Brown\n", "Peter Brown"),
    ("Software Engineer\nPython, AWS\n", ""),
    ("Omar Siddiq | Senior QA Engineer [PHONE] Lahore Pakistan", "Omar Siddiq"),
    ("Time management\nCommunication\n", ""),
    ("Acme Software\nKarachi\n", ""),
    ("Artificial Intelligence\nPyTorch\n", ""),
    ("Time management\nOmar Siddiq\nQA Engineer\n", "Omar Siddiq"),
    ("Finance Analyst\nSkills: Excel\n", ""),
    ("AWS Certified Solutions Architect\nSkills: Python\n", ""),
    ("Certified Kubernetes Administrator\n", ""),
    ("Ines Maria Duarte  ines@mail.com\nData Analyst\nSummary\n", "Ines Maria Duarte"),
    ("Ines Maria Duarte +92-317-4497371\nnothing\n", "Ines Maria Duarte"),
    ("Ines Maria Duarte  E-mail: ines at mail  \nmore\n", "Ines Maria Duarte"),
    ("Ines Maria Duarte  Email: inesmariaduarte02.averylongprefix@gmail.com\nlinkedin.com/in/ines\n+92-317-0000000\n", "Ines Maria Duarte"),
    ("RESUME\nInes Maria Duarte\nData Analyst\n", "Ines Maria Duarte"),
    ("Ines Maria Duarte linkedin.com/in/ines\n", "Ines Maria Duarte"),
    ("word\n" * 60 + "This resume belongs to: — Yusuf Noor Ali —", "Yusuf Noor Ali"),
    ("Yusuf\u200bData Scientist\u200bJo Park\n", "Jo Park"),
    ("Jo Park Lahore\n", "Jo Park"),
    ("Sana Malik Data Scientist\n", "Sana Malik"),
    ("x oe Ss\nab cd ef\n", ""),
    ("Candidate Name: Unknown Candidate\n", ""),
    ("Bo Chan (he/him)\n", "Bo Chan"),
    ("J. K. Rowan\n", "J. K. Rowan"),
    ("Élodie Çelik\nBackend Developer\n", "Élodie Çelik"),
    ("O'NEIL, SEAN P.\n", "Sean P. O'neil"),
    ("Mary Ann Lee Roe Fox Day Sun\n", ""),
    ("x\ny\n", ""),
    (" \n\r\n\t", ""),
    ("", ""),
    (None, ""),
    ("x" * 300_000 + "\n" + "1 " * 20_000 + "\nPeter Brown", "Peter Brown"),
]


def test_names_of_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id int, text string")
    got = {r["id"]: r["name"] for r in names.names_in_text(df).collect()}
    wrong = [(t if t is None else t[-60:], got[i], want) for i, (t, want) in enumerate(TEXTS) if got[i] != want]
    assert not wrong


def test_best_of_guesses(spark):
    """The score of the origin decides; equal scores go by the letters; under the least score there is none."""
    guesses = lambda *g: F.array(*[F.struct(F.lit(s).alias("score"), F.lit(w).alias("name")) for s, w in g])
    row = spark.range(1).select(n.best(guesses((80, "B B"), (86, "C C"), (86, "A A"))).alias("a"), n.best(guesses((34, "A A"))).alias("b"), n.best(guesses((35, "A A"))).alias("c"), n.best(F.lit(None).cast(n.GUESSES)).alias("d")).first()
    assert tuple(row) == ("A A", "", "A A", "")


RESOLVED = [
    ("Sara Quinn\nData Analyst\n", "other.person@x.com", "Sara Quinn", "resume"),
    ("Machine Learning\nPyTorch\n", "lucia.moreno@x.com", "Lucia Moreno", "email"),
    ("x\ny\n", "a@b.co", "", "unknown"),
    (None, None, "", "unknown"),
]


def test_text_goes_before_address(spark):
    """Repeated rows and columns of other names stay as they are."""
    rows = [(i % 2, t, e, "kept") for i, (t, e, _, _) in enumerate(RESOLVED * 2)]
    got = names.resolved_names(spark.createDataFrame(rows, "id int, text string, email string, score string"))
    assert got.columns == ["id", "text", "email", "score", "name", "name_source"]
    assert sorted((r["name"], r["name_source"]) for r in got.collect()) == sorted([(a, s) for _, _, a, s in RESOLVED] * 2)
    assert names.resolved_names(spark.createDataFrame([], "id int, text string, email string")).count() == 0


CASES = {
    n.from_address: [
        ("omar.siddiq@gmail.com", "Omar Siddiq"), ("Mary-Roe@company.org", "Mary Roe"), ("admin@company.org", ""), ("support@company.org", ""), ("no-reply@company.org", ""), ("mary.roe7+jobs@x.org", "Mary Roe"),
        ("a.b.roe@x.org", ""), ("data.analyst@x.org", ""), ("mary.sales@x.org", ""), ("mary.roe", ""), ("one.two.three.four.five@x.org", "One Two Three Four"), ("", ""), (None, ""), (f"{'ab.' * 30}cd@x.org", ""),
    ],
    n.from_file_stem: [
        ("Mary_Roe", "Mary Roe"), ("Mary_Roe_Resume", "Mary Roe"), ("My_Resume_Final", ""), ("1775595018794_19DF", ""), ("sample_resume", ""), ("Finance_Analyst_Resume", ""), ("Hana_Finance", ""), ("mary resume", ""),
        ("MARY-ROE-CV2", "Mary Roe"), ("12 Mary Roe", ""), ("", ""), (None, ""), ("a" * 57, ""),
    ],
    n.from_file_name: [("up/Mary_Roe.pdf", "Mary Roe"), ("Mary_Roe.final.docx", "Mary Roe.final"), (".profile", ".profile"), (" ", ""), (None, "")],
    n.from_profile_slug: [
        ("mary-roe-1a2b3c4d", "mary roe"), ("mary-roe", "mary roe"), ("m%C3%A9lanie-roe-b12345", "mélanie roe"), ("abcdef12", "abcdef12"), ("facade-decade", "facade"), ("mary+ann-roe", "mary ann roe"), ("100%", "100%"), ("--", "--"), ("", ""), (None, ""),
    ],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_names_of_addresses_and_files(spark, function):
    df = spark.createDataFrame([(a, b) for a, b in CASES[function]], "value string, want string")
    wrong = df.withColumn("got", function(F.col("value"))).where("got is distinct from want").collect()
    assert not wrong


def test_ends_and_glances_change_nothing(spark):
    """Ends are cut by a list of white space, as the pattern says; what is passed over by a glance has no name."""
    signs = [chr(c) for c in [*range(0x250), *range(0x1600, 0x1900), *range(0x2000, 0x2100), 0x3000, 0xFEFF]]
    df = spark.createDataFrame([(f"{c}a{c} b{c}\n{c}",) for c in signs] + [("",), (" \n",)], "t string")
    cut = n._strip(F.col("t"))
    assert "regexp_replace" not in df.select(cut)._jdf.queryExecution().optimizedPlan().toString()
    assert df.where(cut != F.regexp_replace("t", r"(?U)^[\s]+|[\s]+$", "")).count() == 0
    raws = ["Dr. Ann Maria Jo Lee Von Ray •", " Mr. Ann Maria Jo Lee Von Ray •", "Ray, Ann", "Ann Ray (the 2nd of 3 and more words than a name has)", "one two three four five six seven eight nine", "Ann Ray 7", "A.B. Ray"]
    got = spark.range(1).select(n.normalised(F.array(*[F.struct(F.lit(i).alias("score"), F.lit(r).alias("raw")) for i, r in enumerate(raws)])).alias("x")).first()["x"]
    assert [(x["score"], x["name"]) for x in got] == [(0, "Ann Maria Jo Lee Von Ray"), (1, "Ann Maria Jo Lee Von Ray"), (2, "Ann Ray"), (3, "Ann Ray")]
    said = ["prepared by Ann Ray", "Reſume of Ann Ray", "THIS RESUME BELONGS TO - Ann Ray", "presented by Ann Ray"]
    assert [r["o"][0]["raw"] for r in spark.createDataFrame([(x,) for x in said], "t string").coalesce(1).select(n.owner(F.col("t")).alias("o")).collect()] == ["Ann Ray", "Ann Ray", "Ann Ray", ""]
