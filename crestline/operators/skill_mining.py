"""Skills of free texts by a lexicon: lists behind headings, lines full of skills, and known phrases anywhere.

The lexicon is a relation, so it can be as long as an automaton holds: phrases
to look for, skills that count, spellings and what they stand for, and the
domains of skills. All phrases are found in one pass over a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.chrome import ADVERT, PLAIN_QUOTES, QUOTES, SECTION
from crestline.operators.resume import without_page_chrome

# What is cut out of an entry or off its ends, and how lists are split.
URL = r"(https?://\S+|www\.\S+)"
ENTRY_EDGES = " \t\n\r.,;:()[]{}<>|/\\\"'"
LIST_SPLIT = r"[,\x{2022}|;/]+|\s{2,}"
# A line with one of these may be full of skills; at least so many have to be known. Names of
# several words stand without spaces, as they are to match so.
HEAVY = [
    "python", "java", "javascript", "typescript", "sql", "html", "css", "php", "node", "react", "docker", "aws", "azure", "gcp", "kubernetes", "c++",
    "chr", "humanresources", "recruitment", "talent", "onboarding", "payroll", "workday", "hris", "ats", "employee",
    "figma", "sketch", "photoshop", "illustrator", "indesign", "aftereffects", "premiere", "adobe", "ui/ux", "wireframing", "prototyping", "branding", "typography",
    "pandas", "numpy", "scikit", "sklearn", "tensorflow", "pytorch", "spark", "airflow", "kafka", "bigquery", "etl", "datascience", "machinelearning", "ml",
    "seo", "marketing", "sales", "businessdevelopment", "leadgeneration", "crm", "salesforce", "hubspot", "zoho", "pipedrive",
    "googleanalytics", "googleads", "metaads", "mailchimp", "linkedin",
    "finance", "accounting", "audit", "tax", "ifrs", "gaap", "fp&a", "budgeting", "forecasting", "quickbooks", "xero", "tally", "sap", "netsuite", "ledger", "reconciliation",
    "qa", "testing", "selenium", "cypress", "playwright", "appium", "postman", "soapui", "jira", "testrail", "zephyr", "jmeter", "k6", "browserstack",
    "product", "roadmap", "userstories", "backlog", "scrum", "agile", "kanban", "requirements", "stakeholder", "prd", "mvp",
    "operations", "ops", "process", "sop", "compliance", "vendor", "procurement", "inventory", "logistics", "servicedelivery", "dashboard", "reporting",
]
HEAVY_LEAST, HEAVY_CHARS = 6, 10
HEAVY_TOKEN = r"[A-Za-z][A-Za-z0-9+#.]{1,}(?:\.[A-Za-z0-9]+)?"
# What looks like a tool's name, and signs that only such names have.
TECH = r"[a-z]{2,}\.[a-z0-9.]{1,}|c\+\+|c#|f#|\.net|(?:s3|ec2|eks|ecs|ecr|lambda|route53)|[a-z]{3,}(?:-[a-z0-9]{2,})+"
SIGNS = ".+#"
# Entries of one or two letters that count in lists.
SHORT_IN_LISTS = ["r", "c", "go", "vba", "s3", "ec2"]
# Spellings that come before those of the lexicon; some stand for nothing.
SPELLINGS = {
    "react.js": "react",
    "nodejs": "node.js",
    "postgres": "postgresql",
    "microsoft excel": "ms excel",
    "visual basic for excel": "vba",
    "amazon web services": "aws",
    "fastai": "fast.ai",
    "github-actions": "github actions",
    "github action": "github actions",
    "githubactions": "github actions",
    "c#.net": "c#",
    "c#net": "c#",
    "end-to-end": "",
    "end to end": "",
    "data-driven": "",
}
# Entries that are no skills, and what no skill has in it.
STOP = ["and", "or", "the", "a", "an", "to", "of", "in", "for", "with", "on", "at", "from", "by", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those"]
COMMON = [
    "resume", "cv", "curriculum", "vitae", "page", "pages", "section", "reference", "references", "email", "phone", "address", "contact", "present", "work", "worked", "using", "use", "team",
    "professional", "projects", "project", "experience", "education", "summary", "profile", "university", "college", "school", "institute",
    "management", "development", "business", "system", "software", "solutions", "tools", "design", "skills", "objective",
]
BRANDS = ["deeplearning.ai", "coursera", "udemy", "edx", "kaggle", "linkedin.com", "github.com", "gmail.com", "yahoo.com", "hotmail.com", "gmail.co", "pvt.ltd"]
DOMAIN_NAME = r"\b[a-z0-9\-]+\.(com|net|org|io|edu|pk|ai|co|ltd)\b"
SELF_PRAISE = ["results-driven", "detail-oriented", "user-friendly", "hands-on", "high-", "well-", "real-time", "real-world", "fast-paced", "self-motivated"]
MISREAD = r"o[a-z]{5,}|.*\d{3,}.*"

_URL, _SPACES, _SECTION, _SPLIT = re.compile(URL, re.I), re.compile(r"\s+"), re.compile(SECTION), re.compile(LIST_SPLIT.replace(r"\x{2022}", "•"))
# The edge of a heavy word is one of ASCII letters, as in the SQL: an accented letter ends it, as it ends a HEAVY_TOKEN.
_HEAVY = re.compile(rf"\b({'|'.join(map(re.escape, HEAVY))})\b", re.I | re.A)
_HEAVY_TOKEN, _TECH, _DOMAIN, _MISREAD = re.compile(HEAVY_TOKEN), re.compile(TECH), re.compile(DOMAIN_NAME), re.compile(MISREAD, re.S)
_NO_SKILLS, _IN_NONE = frozenset([*STOP, *COMMON, *BRANDS]), [*SELF_PRAISE, *ADVERT]
_PLAIN = str.maketrans(QUOTES, PLAIN_QUOTES)


@dataclass
class Lexicon:
    """Rows of a lexicon by kind: phrase, tool (value unused), spelling (form to value) and domain (a skill to its domain)."""

    rows: list[tuple[str, str, str | None]]
    tools: set[str] = field(default_factory=set)
    spellings: dict[str, str] = field(default_factory=dict)
    domains: dict[str, set[str]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for kind, form, value in self.rows:
            if kind == "phrase" and form:
                self.phrases.add_word(form.lower(), form.lower())
            elif kind == "tool":
                self.tools.add(form)
            elif kind == "spelling":
                self.spellings[form] = value or ""
            elif kind == "domain":
                self.domains.setdefault(form, set()).add(value)
        self.phrases.make_automaton()

    def entry(self, written: str) -> str:
        """An entry in its one spelling, or nothing."""
        x = _SPACES.sub(" ", _URL.sub(" ", written.strip().lower())).strip(ENTRY_EDGES)
        x = SPELLINGS.get(x, x)
        return self.spellings.get(x, x).strip()

    def phrases_in(self, text: str) -> Iterator[str]:
        """Phrases between word boundaries from left to right, none within another; of those that begin together the first by the alphabet."""
        if not len(self.phrases):
            return
        word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        edge = lambda i: word(i - 1) != word(i)
        found = sorted((end - len(p) + 1, p) for end, p in self.phrases.iter(text))
        free = 0
        for start, phrase in found:
            if start >= free and edge(start) and edge(start + len(phrase)):
                free = start + len(phrase)
                yield phrase

    def skills(self, text: str) -> list[str]:
        """A text's skills, each once: from its lists, then its lines full of skills, then phrases, then names of tools."""
        out: dict[str, None] = {}
        heavy: list[str] = []
        for line in text.splitlines():
            line = line.strip()
            if m := _SECTION.match(line):
                for part in _SPLIT.split(m[2].replace("(", ", ").replace(")", " ")):
                    x = self.entry(part)
                    if is_skill(x) and (len(x) > 2 or x in SHORT_IN_LISTS):
                        out[x] = None
            if len(line) >= HEAVY_CHARS and _HEAVY.search(line):
                known = [x for x in map(self.entry, _HEAVY_TOKEN.findall(line)) if is_skill(x) and (x in self.tools or any(s in x for s in SIGNS))]
                heavy += known if len(known) >= HEAVY_LEAST else []
        low = _URL.sub(" ", text.translate(_PLAIN).lower())
        for x in map(self.entry, [*self.phrases_in(low), *_TECH.findall(low)]):
            if is_skill(x) and (x in self.tools or "." in x):
                heavy.append(x)
        return list(out | dict.fromkeys(heavy))


def is_skill(x: str) -> bool:
    if not x or x in _NO_SKILLS or x[0] == "-" or x[-1] == "-" or _DOMAIN.search(x) or _MISREAD.fullmatch(x):
        return False
    plain = x.translate(_PLAIN)
    return not any(part in plain for part in _IN_NONE)


def mined_skills(texts: DataFrame, lexicon: DataFrame, most: int = 200_000) -> DataFrame:
    """id, skills (array, in order of where they are found) and domains (array, by the alphabet) of each row of texts (id, text).

    lexicon has kind, form and value, see Lexicon. It goes to every task, so it
    may have `most` rows; more is an error, not a cut. Menus and adverts of
    pasted pages are left out first. A null or empty text has no skills.
    """
    rows = [tuple(r) for r in lexicon.select("kind", "form", "value").where("form is not null").distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} rows")
    shared = texts.sparkSession.sparkContext.broadcast(sorted(rows, key=repr))
    clean = without_page_chrome(texts.select("id", F.coalesce("text", F.lit("")).alias("text")))

    def run(batches):
        known = Lexicon(shared.value)
        for batch in batches:
            skills = [known.skills(text or "") for text in batch.column(1).to_pylist()]
            domains = [sorted(set().union(*(known.domains.get(x, ()) for x in found))) for found in skills]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(skills, pa.list_(pa.string())), pa.array(domains, pa.list_(pa.string()))], names=["id", "skills", "domains"])

    kind = clean.schema["id"].dataType.simpleString()
    return clean.select("id", "clean").mapInArrow(run, f"id {kind}, skills array<string>, domains array<string>")
