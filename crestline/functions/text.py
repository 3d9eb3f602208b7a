"""Text expressions: personal data, titles, roles and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed values.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{2,4}[\s.-]?\d{2,4}(?:[\s.-]?\d{2,4})?\b"
URL = r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+|linkedin\.com/[^\s<>\"']+|github\.com/[^\s<>\"']+"
ROLE_BUCKETS = [
    ("ml", ["machine learning", "deep learning", "artificial intelligence", " ai ", " ml ", "ai/ml", "ml/ai", "nlp", "data scientist", "computer vision"]),
    ("design", ["ui", "ux", "designer", "product designer", "visual", "graphics", "graphic"]),
    ("frontend", ["frontend", "front-end", "react", "web"]),
    ("backend", ["backend", "back-end", "api", "server"]),
    ("fullstack", ["fullstack", "full-stack"]),
    ("devops", ["devops", "sre", "site reliability", "kubernetes"]),
    ("qa", ["qa", "quality", "tester", "testing"]),
    ("data", ["data", "analyst", "bi", "warehouse"]),
    ("finance", ["finance", "account", "accounting"]),
    ("hr", ["hr", "recruit", "talent"]),
    ("ops", ["operations", "ops", "admin"]),
]
ALLOWED = {
    "design": ["ui", "ux", "designer", "product designer", "visual", "graphic", "graphics"],
    "frontend": ["frontend", "front-end", "react", "web", "ui"],
    "backend": ["backend", "back-end", "api", "server"],
    "fullstack": ["fullstack", "full-stack", "frontend", "backend"],
    "devops": ["devops", "sre", "kubernetes", "docker", "cloud"],
    "qa": ["qa", "tester", "testing", "quality"],
    "data": ["data", "analyst", "bi", "warehouse", "scientist", "ml", "ai"],
    "ml": ["ml", "ai", "machine", "deep", "data", "scientist", "research", "engineer", "developer", "software", "nlp", "vision"],
    "finance": ["finance", "account", "accounting"],
    "hr": ["hr", "recruit", "talent"],
    "ops": ["operations", "ops", "admin"],
}
REJECTED = {
    "design": ["backend", "devops", "qa", "account", "finance", "hr"],
    "frontend": ["devops", "qa", "account", "finance", "hr"],
    "backend": ["designer", "ux", "ui designer", "graphic", "qa"],
    "devops": ["designer", "ux", "ui", "frontend", "qa"],
    "ml": ["designer", "ux", "ui designer", "graphic", "account", "finance", "hr", "recruit"],
}


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_pii(c: Column, email: bool = True, phone: bool = True, url: bool = True) -> Column:
    """Addresses, then telephone numbers, then links give way to placeholders; white space is collapsed. Null is empty."""
    out = F.coalesce(c, F.lit(""))
    for wanted, pattern, name in ((email, EMAIL, "EMAIL"), (phone, PHONE, "PHONE"), (url, URL, "URL")):
        if wanted:
            out = F.regexp_replace(out, pattern, f" [{name}] ")
    return collapse(out)


def contains_pii(c: Column) -> Column:
    return c.rlike(EMAIL) | c.rlike(PHONE) | c.rlike(URL)


def _any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def role_bucket(title: Column) -> Column:
    """The first bucket, in order, that any part of the title names."""
    t = collapse(F.lower(F.coalesce(title, F.lit(""))))
    edge = t.startswith("ai ") | t.startswith("ml ") | t.endswith(" ai") | t.endswith(" ml")
    out = F.when(_any(t, ROLE_BUCKETS[0][1]) | edge, "ml")
    for name, needles in ROLE_BUCKETS[1:]:
        out = out.when(_any(t, needles), name)
    return out.otherwise("other")


def matches_role(bucket: Column, title: Column, role_label: Column) -> Column:
    """Rejected parts win, then an allowed one is needed; bucket other and an empty title allow all."""
    hay = collapse(F.lower(F.concat_ws(" ", title, role_label)))
    out = F.when((bucket == "other") | (hay == ""), True)
    for name, allowed in ALLOWED.items():
        out = out.when(bucket == name, ~_any(hay, REJECTED.get(name, [])) & _any(hay, allowed))
    return out.otherwise(True)


# What shows a kind of work in a title or in skills, in the order in which it is asked.
QA_WORK = r"\b(qa|sqa|test(er|ing)?|quality assurance|automation|selenium|cypress|playwright|appium|jmeter|k6)\b"
BACKEND_WORK = r"\b(backend|api|microservices?|django|flask|fastapi|spring|node(\.js)?|express|nest|laravel|rails|postgres|mysql|mongodb)\b"
FRONTEND_WORK = r"\b(frontend|react(?:\s+native)?|angular|vue|next\.js|nuxt|flutter|typescript|ui|ux|css|html|tailwind|bootstrap)\b"
MOBILE_WORK = r"\b(android|ios|swift|kotlin|xamarin|ionic)\b"
DATA_WORK = r"\b(data (engineer|science|scientist)|ml|machine learning|deep learning|pytorch|tensorflow|nlp)\b"
SOFTWARE_TITLES = ["software engineer", "associate software engineer", "developer", "engineer"]
# A title and the parts of skills that speak for it; of equal counts the first title wins.
TITLE_SKILLS = {
    "software engineer": ["software engineer", "software development"],
    "full stack developer": ["full stack", "web development", "html css", "react", "node.js", "javascript", "mongodb", "mysql", "postgresql"],
    "mobile developer": ["react native", "mobile application"],
    "backend developer": ["node.js", "django", "flask", "express.js", "nestjs", "postgresql", "mysql"],
    "frontend developer": ["react", "html", "css", "javascript"],
    "devops engineer": ["aws", "docker", "kubernetes", "terraform"],
    "qa engineer": ["selenium", "automation", "postman"],
    "ui/ux designer": ["figma", "prototyping", "wireframing"],
    "data scientist": ["machine learning", "python", "pandas", "numpy", "scikit-learn"],
    "data analyst": ["sql server", "power bi", "excel"],
    "business development executive": ["business development", "lead generation"],
    "email marketing specialist": ["email marketing", "campaign"],
    "social media manager": ["social media", "digital marketing"],
    "data entry operator": ["data entry"],
    "customer service representative": ["customer service"],
}
# How a job's text states the years that it asks for, in the order in which they count, and its degree.
YEARS_ASKED = [
    (r"\b(\d{1,2})\s*[-–to]+\s*(\d{1,2})\s*(?:years?|yrs?)\b", 1),
    (r"\b(minimum|min)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b", 2),
    (r"\b(at\s+least)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b", 2),
    (r"\b(\d{1,2})\s*\+?\s*(?:years?|yrs?)\s+of\s+experience\b", 1),
]
ANY_YEARS = r"\b(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b"
DEGREE_ASKED = [("phd", r"\b(ph\.?d|doctorate)\b"), ("masters", r"\b(master'?s|msc|ms)\b"), ("bachelors", r"\b(bachelor'?s|bs|bsc|be|b\.e)\b")]
#: Punctuation whose UTF-8 bytes, read as Windows-1252, are put right where that reading exists.
MENDED = {}
for _sign in "\u2013\u2014\u2019\u201c\u201d\u2022\u00b7":
    try:
        MENDED[_sign.encode().decode("cp1252")] = _sign
    except UnicodeDecodeError:
        pass


def role_fine(title: Column, skills: Column, hint: Column) -> Column:
    """The kind of work that a title, skills and a hint show: the title's own testing first, then what the skills ask for, then the title."""
    t, s, h = (collapse(F.lower(F.coalesce(c, F.lit("")))) for c in (title, skills, hint))
    stack, whole = F.concat_ws(" ", s, h), F.concat_ws(" ", t, s, h)
    back, front = stack.rlike(BACKEND_WORK), stack.rlike(FRONTEND_WORK)
    return (
        F.when(F.trim(whole) == "", "unknown").when(t.rlike(QA_WORK), "qa").when(back & front, "fullstack").when(back, "backend").when(front, "frontend")
        .when(_any(t, SOFTWARE_TITLES), "software").when(whole.rlike(DATA_WORK), "data").when(whole.rlike(MOBILE_WORK), "software").when(stack.rlike(QA_WORK), "qa").otherwise("other")
    )


def title_from_skills(skills: Column) -> Column:
    """The title for which most parts lie in any of the skills, the first of equal ones; none gives unknown."""
    have = F.transform(F.split(F.coalesce(skills, F.lit("")), ","), lambda x: F.trim(F.lower(x)))
    held = lambda part: F.exists(have, lambda x: F.contains(x, F.lit(part)))
    found = []
    for place, (title, parts) in enumerate(TITLE_SKILLS.items()):
        count = sum((held(part).cast("int") for part in parts), F.lit(0))
        found.append(F.struct(count.alias("count"), F.lit(-place).alias("place"), F.lit(title).alias("title")))
    best = F.array_max(F.array(*found))
    return F.when(best["count"] > 0, best["title"]).otherwise("unknown")


def years_asked(c: Column) -> Column:
    """The least years that a job's text asks for: by its first statement of the strongest kind, else the least number of years in it; null without any."""
    t = F.lower(c)
    stated = [F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).cast("int") for pattern, group in YEARS_ASKED]
    return F.coalesce(*stated, F.array_min(F.transform(F.regexp_extract_all(t, F.lit(ANY_YEARS), F.lit(1)), lambda x: x.cast("int"))))


def degree_asked(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit("any")
    for name, pattern in reversed(DEGREE_ASKED):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def mended(c: Column) -> Column:
    """Punctuation that was read in the wrong encoding as it was meant."""
    for wrong, right in MENDED.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def resume_text(c: Column) -> Column:
    """Line ends, spaces and control characters put right, at most two empty lines in a row, and words joined that a hyphen parts at a line's end."""

    def spaced(t: Column) -> Column:
        t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        t = F.regexp_replace(t, "[\u00a0\u2007\u202f]", " ")
        t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        return F.regexp_replace(F.regexp_replace(t, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")

    joined = F.regexp_replace(spaced(F.coalesce(c, F.lit(""))), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    return spaced(joined)
