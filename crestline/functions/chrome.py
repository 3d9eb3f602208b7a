"""Lines of a profile page that was pasted whole: menus, footers, advert forms, cards of other people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions.resume import trimmed

# One of the first or two of the second mean that a page was pasted.
PASTED = ["people also viewed", "people you may know", "similar profiles", "visit our help center", "skills (from page)", "endorsed by", "endorsements"]
PASTED_PAIR = ["don't want to see this", "your feedback will help", "same ad too often", "talent solutions", "community guidelines", "visit our help center", "manage your account", "ad choices", "marketing solutions"]
# Lines of menus and footers, and what only such lines hold.
MENU = [
    "about", "accessibility", "talent solutions", "community guidelines", "careers", "marketing solutions", "ad choices", "advertising", "sales solutions", "mobile", "small business", "safety center",
    "visit our help center", "go to your settings", "manage your account and privacy", "manage your account", "questions?", "help center", "privacy policy", "user agreement", "cookie policy", "ad preferences",
    "select language", "sign out", "join now", "sign in",
]
FOOTER = [
    "linkedin.com/", "© linkedin", "(linkedin)", "linkedin corporation", "linkedin talent solutions", "linkedin learning", "get the linkedin app", "people also viewed", "people you may know", "similar profiles",
    "you might like", "promoted", "sponsored", "visit our help",
]
ADVERT = [
    "don't want to see this", "do not want to see this", "your feedback will help us improve", "it's annoying or not interesting", "it is annoying or not interesting", "i've seen the same ad too often",
    "i have seen the same ad too often", "same ad too often", "please let us know", "tell us why", "not relevant", "report this ad", "and many more",
]
CHIPS = [
    "web design", "mobile interface design", "user interface design", "user experience design (ued)", "user experience design", "adobe photoshop", "adobe illustrator", "figma (software)", "figma", "adobe xd",
]
# Headings before a colon that make a line a section of its own.
SECTIONS = [
    "skills", "technical skills", "core skills", "technologies", "tools", "tech stack", "programming", "languages", "frameworks", "libraries", "databases", "devops", "cloud", "ci/cd", "certifications", "testing", "qa",
    "backend", "frontend", "hr", "human resources", "recruitment", "talent acquisition", "professional summary", "design", "ui/ux", "ux", "ui", "design tools", "creative skills", "software", "data science",
    "machine learning", "ml", "deep learning", "research", "analytics", "data engineering", "marketing", "digital marketing", "sales", "business development", "business", "business & marketing", "sales & marketing",
    "platforms", "finance", "accounting", "financial", "financial skills", "accounts", "tax", "audit", "sqa", "test automation", "quality assurance", "product", "product management", "product owner",
    "business analysis", "business analyst", "requirements", "responsibilities", "operations", "business operations", "ops", "operational", "process", "compliance", "procurement", "vendor",
]
SECTION = r"(?i)^\s*(" + "|".join(SECTIONS) + r")\s*:\s*(.+)$"
# A place of work, a person's name alone, a brand in capitals, an advertiser's line.
ON_SITE = r"(?:^|\s)·\s*on-?site\b|^on-?site\b"
PERSON = r"^(?:[A-Z][a-z]{1,22}\s+[A-Z][a-z]{1,22}|[A-Z]\s+[A-Z][a-z]{1,23})$"
BRAND = r"^[A-Z0-9][A-Z0-9!\.]{1,18}$"
ADVERTISER = r"(?i)(?:\d+\+?\s*(?:yrs?|years)\b.*\b(?:design|designing|dashboard|cro|clicks|customers)\b)|(?:\bturning\s+clicks\s+into\b)|(?:\bhigh[-\s]?conversion\b)"
SHORT_LINE = 120
#: Typographic quotes and what stands for them.
QUOTES, PLAIN_QUOTES = "‘’′´“”", "''''\"\""
#: Where a line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def lowered(c: Column) -> Column:
    return F.lower(F.translate(c, QUOTES, PLAIN_QUOTES))


def is_pasted(text: Column) -> Column:
    """Whether a text looks like a page with its menus rather than a résumé."""
    low = F.transform(F.array(lowered(text)), lambda t: _any(t, PASTED) | (sum((F.contains(t, F.lit(w)).cast("int") for w in PASTED_PAIR), F.lit(0)) >= 2))
    return low[0]


def line_views(lines: Column) -> Column:
    """Of each line, without white space behind, what is_chrome() looks at: made once for it, step by step, as a lambda's parts are computed where they stand."""
    first = F.transform(lines, lambda x: F.struct(x.alias("raw"), lowered(x).alias("low"), trimmed(x).alias("alone")))
    lowers = F.transform(first, lambda v: F.struct(v["raw"].alias("raw"), v["low"].alias("low"), v["alone"].alias("alone"), trimmed(v["low"]).alias("bare_low")))
    chips = F.transform(
        lowers,
        lambda v: F.struct(
            v["raw"].alias("raw"), v["low"].alias("low"), v["alone"].alias("alone"), F.regexp_replace(v["bare_low"], r"[\s\.!?]+$", "").alias("menu"),
            F.regexp_replace(F.regexp_replace(v["bare_low"], r"\s+", " "), r"[.!?]+$", "").alias("chip"),
        ),
    )
    return chips


def is_chrome(view: Column, pasted: Column) -> Column:
    """Whether a line, as one of line_views(), is the page's and not the résumé's; a blank line never is."""
    raw, low, alone, menu, chip = (view[c] for c in ("raw", "low", "alone", "menu", "chip"))
    own = alone.rlike(SECTION)
    bare = trimmed(F.regexp_replace(chip, r"\s*\(software\)\s*$", ""))
    plain = trimmed(F.regexp_replace(bare, r"\s*\(ued\)\s*$", ""))
    anywhere = menu.isin(MENU) | low.rlike(ON_SITE) | (F.contains(low, F.lit("on-site")) & (F.length(raw) <= SHORT_LINE)) | _any(low, FOOTER) | (_any(low, ADVERT) & ~own) | F.contains(low, F.lit("clients include"))
    of_page = F.contains(low, F.lit("boom!")) | raw.rlike(ADVERTISER) | chip.isin(CHIPS) | bare.isin(CHIPS) | plain.isin(CHIPS) | (~own & (alone.rlike(PERSON) | alone.rlike(BRAND)))
    return (alone != "") & (anywhere | (pasted & of_page))


def text_lines(c: Column) -> Column:
    """The lines of a text without white space behind; a line's end at the end of the text starts no other."""
    parts = F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
