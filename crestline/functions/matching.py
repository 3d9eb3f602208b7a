"""Skill phrases with their other spellings, the guard of titles, role labels, departments and profile scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions.text import collapse

# Spellings of one skill.
ALIASES = [
    ["tensorflow", "tensor flow", "tf"],
    ["pytorch", "torch"],
    ["scikit-learn", "scikit learn", "scikitlearn", "sklearn"],
    ["machine learning", "machinelearning", "ml"],
    ["deep learning", "deeplearning", "dl"],
    ["artificial intelligence", "artificialintelligence", "ai"],
    ["natural language processing", "nlp"],
    ["computer vision", "cv"],
    ["retrieval-augmented generation", "retrieval augmented generation", "retrievalaugmentedgeneration", "rag"],
    ["large language model", "large language models", "llm", "llms"],
    ["model context protocol", "model context protocols", "mcp"],
    ["javascript", "js"],
    ["typescript", "ts"],
    ["kubernetes", "k8s"],
    ["postgresql", "postgres"],
    ["amazon web services", "aws"],
    ["google cloud platform", "google cloud", "gcp"],
    ["microsoft azure", "azure"],
    ["continuous integration", "ci"],
    ["continuous deployment", "cd"],
    ["ci/cd", "cicd", "continuous integration continuous deployment"],
]
NO_SKILL = ["none", "n/a", "na", "null", "-", "—"]
SKILL_STOPS = ["and", "or", "with", "to", "in", "of", "the", "a", "an", "for", "on", "api", "apis"]
PHRASE_ENDS = r"[,\n;/|]+"
BULLETS = r"^[\s•●▪■−–—\-*+]+"
FRAGMENT_EDGES = " \t\r\n.,;:|/\\"
KEYWORD = r"[a-z0-9][a-z0-9+\-#.]*"
GENERIC_TITLE_WORDS = ["engineer", "developer", "specialist", "manager", "senior", "junior", "lead", "intern", "associate", "principal", "staff"]
NO_TITLE = ["home", "unknown", "job", "role"]
# A title's label among several departments, and among engineers alone.
ROLE_LABELS = {
    "frontend developer": "frontend",
    "frontend": "frontend",
    "backend developer": "backend",
    "backend": "backend",
    "full stack developer": "fullstack",
    "fullstack developer": "fullstack",
    "full stack": "fullstack",
    "fullstack": "fullstack",
    "software engineer": "fullstack",
    "software developer": "fullstack",
    "mobile developer": "fullstack",
    "devops engineer": "devops",
    "qa engineer": "qa",
    "ui/ux designer": "design",
    "graphic designer": "design",
    "product designer": "design",
    "data scientist": "data",
    "data analyst": "data",
    "data engineer": "data",
    "machine learning engineer": "data",
    "product manager": "product",
    "product owner": "product",
    "business analyst": "product",
    "business development executive": "marketing",
    "email marketing specialist": "marketing",
    "social media manager": "marketing",
    "digital marketing": "marketing",
    "hr officer": "hr",
    "hr manager": "hr",
    "recruiter": "hr",
    "talent acquisition": "hr",
    "data entry operator": "operations",
    "customer service representative": "operations",
    "operations manager": "operations",
}
ENGINEERING_LABELS = {
    "frontend developer": "frontend",
    "frontend": "frontend",
    "backend developer": "backend",
    "backend": "backend",
    "full stack developer": "fullstack",
    "fullstack developer": "fullstack",
    "full stack": "fullstack",
    "fullstack": "fullstack",
    "software engineer": "fullstack",
    "software developer": "fullstack",
    "mobile developer": "fullstack",
    "devops engineer": "backend",
    "qa engineer": "fullstack",
    "ui/ux designer": "frontend",
    "data scientist": "backend",
    "data analyst": "backend",
}
# A department and the words that speak for it; of equal counts the first department wins.
DEPARTMENT_WORDS = {
    "engineering": ["software", "developer", "backend", "frontend", "full stack", "api", "react", "node", "nestjs"],
    "qa": ["qa", "sqa", "testing", "selenium", "cypress", "playwright", "postman", "jira"],
    "design": ["ui", "ux", "ui/ux", "figma", "wireframe", "prototype", "graphic", "illustrator", "photoshop"],
    "data": ["data", "data analyst", "data analytics", "ml", "machine learning", "python", "sql", "pandas", "power bi", "excel"],
    "devops": ["devops", "aws", "docker", "kubernetes", "ci/cd", "jenkins", "terraform"],
    "product": ["product", "roadmap", "user stories", "backlog", "scrum", "prd", "mvp"],
    "marketing": ["marketing", "seo", "ads", "google analytics", "content", "social media"],
    "sales": ["sales", "business development", "lead generation", "crm", "pipeline"],
    "hr": ["hr", "recruitment", "talent", "onboarding", "payroll", "hris", "ats"],
    "finance": ["finance", "accounting", "audit", "ifrs", "budgeting", "forecasting", "ledger"],
    "operations": ["operations", "process", "sop", "compliance", "vendor", "procurement", "logistics"],
}
# Parts that make a word no core skill, and parts that make it one.
NOT_CORE = ["-", "driven", "oriented", "friendly", "motivated", "hands", "end", "real", "high", "well", "based", "level", "time", "site", "date"]
CORE = [
    "python", "java", "javascript", "typescript", "react", "node", "docker",
    "sql", "mysql", "postgresql", "mongodb", "aws", "azure", "gcp",
    "linux", "git", "github", "kubernetes", "tensorflow", "pytorch",
    "django", "flask", "fastapi", "laravel", "spring", "nestjs",
    "numpy", "pandas", "opencv", "scikit", "jwt", "oauth",
]
# Words of a role, of a firm's name, and of a sentence.
ROLE_WORDS = ["engineer", "developer", "designer", "analyst", "scientist", "manager", "specialist", "consultant", "officer", "executive", "lead", "intern", "associate", "architect", "tester", "qa", "sqa"]
FIRM_WORDS = ["pvt", "ltd", "limited", "company", "solutions", "technologies", "technology", "systems", "private", "inc", "llc", "group", "labs", "studio"]
SENTENCE = r"(seeking|looking|dedicated|energetic|motivated)"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def phrases(c: Column) -> Column:
    """The skill phrases of a pasted list in their order, repeats included: bullets and edges cut off, in lower case."""

    def clean(x: Column) -> Column:
        return F.trim(F.lower(F.btrim(collapse(F.regexp_replace(x, BULLETS, "")), F.lit(FRAGMENT_EDGES))))

    return F.filter(F.transform(F.split(_empty(c), PHRASE_ENDS), clean), lambda x: (x != "") & ~x.isin(NO_SKILL))


def spellings(phrase: Column) -> Column:
    """A phrase with and without its spaces and dashes, and all aliases of any of these."""
    known = F.create_map(*[x for group in ALIASES for name in group for x in (F.lit(name), F.array(*map(F.lit, group)))])
    cut = lambda a, b: F.replace(phrase, F.lit(a), F.lit(b))
    forms = F.array(phrase, cut(" ", ""), cut("-", " "), cut("-", ""), cut("_", " "), cut("_", ""))
    return F.array_distinct(F.flatten(F.transform(forms, lambda f: F.concat(F.array(f), F.coalesce(F.element_at(known, f), F.array().cast("array<string>"))))))


def spelled(listed: Column) -> Column:
    """Each phrase as all of its spellings."""
    return F.transform(listed, spellings)


def bag(listed: Column) -> Column:
    """All spellings of all phrases and their single words."""
    words = F.flatten(F.transform(listed, lambda x: F.regexp_extract_all(x, F.lit(KEYWORD), F.lit(0))))
    return F.array_distinct(F.concat(F.flatten(spelled(listed)), F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(SKILL_STOPS))))


def alias_overlap(wanted: Column, have: Column) -> Column:
    """Share of wanted phrases, given as their spellings, of which the bag holds one; nothing wanted gives 0."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.filter(wanted, lambda v: F.arrays_overlap(v, have))) / F.size(wanted))


def flat_overlap(wanted: Column, have: Column, cap: int = 32) -> Column:
    """Common entries of two bags by the wanted ones, of which at most cap (8 to 200) count."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, have)) / F.least(F.size(wanted), F.lit(max(8, min(cap, 200)))))


def title_guard(job_title: Column, title: Column, role_label: Column) -> Column:
    """Whether titles share a word that says something; true where either side has none."""
    said = lambda c: F.array_except(F.regexp_extract_all(F.lower(_empty(c)), F.lit(KEYWORD), F.lit(0)), F.array(*map(F.lit, GENERIC_TITLE_WORDS)))
    job, own = said(job_title), F.array_union(said(title), said(role_label))
    return F.lower(F.trim(_empty(job_title))).isin(NO_TITLE) | (F.size(job) == 0) | (F.size(own) == 0) | F.arrays_overlap(job, own)


def role_label(title: Column, labels: dict[str, str] = ROLE_LABELS, default: str = "other") -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(title))), F.lit(default))


def first_most(counts: dict[str, Column], default: str) -> Column:
    """The name with the highest count, the first of equal ones; the default where all are 0."""
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts.items())]))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def department(title: Column, description: Column, skills: Column | None = None, domains: dict[str, list[str]] | None = None) -> Column:
    """By the domain that most of the skills (an array) are from, else by the most words in title and description, else general."""
    blob = F.lower(F.concat(_empty(title), F.lit(" "), _empty(description)))
    by_words = first_most({d: sum((F.contains(blob, F.lit(w)).cast("int") for w in words), F.lit(0)) for d, words in DEPARTMENT_WORDS.items()}, "general")
    if not domains or skills is None:
        return by_words
    by_skills = first_most({d: F.coalesce(F.size(F.array_intersect(skills, F.array(*map(F.lit, words)))), F.lit(0)) for d, words in domains.items()}, "")
    return F.coalesce(F.nullif(by_skills, F.lit("")), by_words)


def core_skill(word: Column) -> Column:
    any_of = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(word), p))
    return ~any_of(NOT_CORE) & (any_of([".", "+", "#"]) | any_of(CORE))


def clean_title(title: Column) -> Column:
    """At most five words of a title that names a role, without signs and a firm's words; anything else is unknown."""
    t = collapse(F.regexp_replace(F.lower(_empty(title)), r"[^a-z0-9+#.\s\-/]", " "))
    words = F.split(t, " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(FIRM_WORDS))
    sentence = (F.length(t) > 60) | (F.size(words) > 8) | t.rlike(SENTENCE)
    return F.when(~sentence & F.exists(kept, lambda w: w.isin(ROLE_WORDS)), F.array_join(F.slice(kept, 1, 5), " ")).otherwise("unknown")


def experience_bucket(years: Column) -> Column:
    y = F.coalesce(years, F.lit(0.0))
    return F.when(y < 1, "<1").when(y < 3, "1-3").when(y < 5, "3-5").otherwise("5+")


def fallback_score(years: Column, skills: Column, degree: Column, certifications: Column) -> Column:
    """A profile's strength, 0 to 100, where no cohort score is known."""
    listed = F.size(F.filter(F.split(_empty(skills), ","), lambda x: F.trim(x) != ""))
    held = lambda c, points: F.when(F.trim(_empty(c)) != "", points).otherwise(0)
    score = F.least(F.lit(20.0), F.greatest(F.lit(0.0), F.coalesce(years, F.lit(0.0)))) * 4 + F.least(listed, F.lit(30)) * 1.6 + held(degree, 6) + held(certifications, 4)
    return F.least(F.lit(100), F.floor(score + 0.5)).cast("int")
