"""Skills of texts: lists, full lines, phrases, pasted pages, and the limits of a lexicon."""

import pytest

from crestline.operators import skill_mining

LEXICON = [("phrase", p, None) for p in ["machine learning", "machine learning engineering", "conversion rate optimization", "web design", "user experience design", "power bi", "learning path", "c++ core", ".net core"]]
LEXICON += [("tool", t, None) for t in ["python", "sql", "react", "figma", "machine learning", "conversion rate optimization", "ms excel", "aws", "kafka", "java", "c#", "node.js", "power bi", "accessibility", "vba"]]
LEXICON += [("spelling", "ml", "machine learning"), ("spelling", "react.js", "never, as the fixed spelling comes first"), ("spelling", "photoshop", "adobe photoshop"), ("domain", "python", "data"), ("domain", "python", "engineering"), ("domain", "sql", "data"), ("domain", "figma", "design")]


def of(spark, *texts):
    lexicon = spark.createDataFrame([(*r, 1, "x") for r in [*LEXICON, ("tool", None, None)]], "kind string, form string, value string, id int, skills string")
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "id long, text string, skills string, clean int")
    out = sorted(skill_mining.mined_skills(df, lexicon).collect(), key=lambda r: r["id"])
    return [r["skills"] for r in out], [r["domains"] for r in out]


def test_lists_keep_their_order_and_spelling(spark):
    skills, domains = of(spark, "Tools: SQL, React.js | Microsoft Excel / ml; R (base), x, data-driven\nSkills:python,  sql  Figma", "tools:Sql", "Hobbies: python", None, "", "skills:")
    assert skills[0] == ["sql", "react", "ms excel", "machine learning", "r", "base", "python", "figma"]
    assert domains[0] == ["data", "design", "engineering"] and skills[1] == ["sql"] and skills[2:] == [[], [], [], []]


def test_noise_is_left_out_of_lists(spark):
    text = "Skills: and, résumé, resume, gmail.com, team, real-time sync, -x-, abc1234, oracles, see www.x.org now, not relevant, ok then"
    assert of(spark, text)[0] == [["résumé", "see now", "ok then"]]


def test_full_lines_need_six_known_skills(spark):
    assert of(spark, "Python sql React figma java kafka", "Python sql React figma java", "python sql c++ a.b f# kafka words")[0] == [["python", "sql", "react", "figma", "java", "kafka"], [], ["python", "sql", "c++", "a.b", "f#", "kafka"]]
    # Without one of the words that such a line has, none is looked at.
    assert of(spark, "figs vba accessibility g#x d#x e#x i#x h#x")[0] == [[]]


def test_an_accented_letter_ends_a_word_of_a_full_line(spark):
    assert of(spark, "échré c++ g#x d#x e#x i#x h#x", "xchrx c++ g#x d#x e#x i#x h#x")[0] == [["c++", "g#x", "d#x", "e#x", "i#x", "h#x"], []]


def test_phrases_end_at_words_and_do_not_overlap(spark):
    texts = ["Of machine learning engineering.", "machine learning path", "Xmachine learning", "machine learnings", "a Machine  Learning b", "power bi, power bi", "émachine learning"]
    assert of(spark, *texts)[0] == [["machine learning"], ["machine learning"], [], [], [], ["power bi"], []]


def test_names_of_tools(spark):
    assert of(spark, "uses node.js and asp.net; c# on aws-lambda, github.com and ms-dos")[0] == [["node.js", "c#"]]  # asp.net reads as an address


def test_menus_and_adverts_of_pasted_pages(spark):
    footer = "\n\nAbout\nAccessibility\nCareers\nMarketing Solutions\n\n    User experience design\n    conversion rate optimization\n"
    assert of(spark, "Skills: Figma, Adobe Photoshop" + footer)[0] == [["figma", "adobe photoshop", "conversion rate optimization"]]
    pasted = "Don’t want to see this\nYour feedback will help us improve\nIt’s annoying or not interesting\nI’ve seen the same ad too often\nWeb Design\nFigma (Software)\nTalent Solutions\nOliver Kenyon\nGFUEL\n13 years turning clicks into customers with CRO\nClients include Portland\n4+ yrs designing high-conversion websites (Figma)\n"
    assert of(spark, pasted + "Python: not a heading\nTools: sql")[0] == [["sql"]]
    named = of(spark, "People also viewed\nKamran Azmat\nM Muzammal\n\nSkills: Python, SQL, React\n\nVisit our Help Center · Settings")[0][0]
    assert named == ["python", "sql", "react"]
    assert of(spark, "Skills: Figma, Don't want to see this, React\n")[0] == [["figma", "react"]]


def test_a_lexicon_has_a_bound_and_may_be_empty(spark):
    texts = spark.createDataFrame([(1, "Skills: sql\nmachine learning node.js")], "id long, text string")
    lexicon = spark.createDataFrame(LEXICON, "kind string, form string, value string")
    with pytest.raises(ValueError, match="more than 5 rows"):
        skill_mining.mined_skills(texts, lexicon, most=5)
    assert skill_mining.mined_skills(texts, lexicon.where("false")).first()["skills"] == ["sql", "node.js"]
    assert skill_mining.mined_skills(texts.where("false"), lexicon).count() == 0
