"""Education lines of résumé texts: which lines, what is cut from them, which neighbours are one entry.

Lines are arrays, and neighbours are merged by a fold that carries the open
entry. All of it stays column expressions; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions import resume as cv

# How many lines count, and how long they may be.
MOST_ENTRIES, LONGEST_ENTRY, LONGEST_LINE, LONGEST_LOOSE_LINE, LONGEST_SCHOOL_LINE, LONGEST_LEAK, SHORTEST_PIECE = 8, 200, 480, 260, 220, 80, 10
# Schools and degrees.
SCHOOL = r"(?i)\b(university|college|institute|school|academy|univ\.?|polytechnic|conservatory)\b"
SCHOOL_LINE = r"(?i)\b(university|college|institute|school|academy|polytechnic|conservatory|univ\.?)\b|(?:^|\s)(?:MIT|CMU|NYU|USC|GT|UIUC)(?:\s|,|$)"
DEGREE_WORD = r"\b(g\.?pa|major|minor|graduat|diploma|dipl\.)\b"
OWN_SECTIONS = ["education", "academic", "qualifications"]
# Lines of other sections and of profile pages.
LEAK = (
    r"(?i)\b(work experience|employment history|professional experience|career history|skills\s*:|\bskills\s+and\b|\btechnical skills\b|\bprojects?\b|\bportfolio\b|\bachievements?\b|"
    r"\breferences?\s*(?:available)?|\blanguages?\s*(?:known)?|\binterests?\b|\bhobbies\b|\bawards?\b|\bhonou?rs?\b|\bpublications?\b)\b"
)
NOISE = r"(?i)\band\s*\+\s*\d+\s*skills?\b|^\s*activities\s+and\s+societies\s*:|^\s*grade:\s*pass\s*$|^(?:sports|coding|football|music|cricket)$"
MONTHS_ALONE = r"(?i)^[A-Za-z]{3,9}\s+\d{4}\s*[–—-]\s*(?:[A-Za-z]{3,9}\s+\d{4}|present)\s*$"
FIRST_PERSON = r"(?i)\b(hello there|I underwent|I am now|I am a|I'm a|I’m a|my journey|enrolled in|now I am)\b"
LONGEST_MONTHS, LONGEST_STORY = 43, 90
# Where skills begin that run on behind a degree.
SKILLS_TAIL = (
    r"(?i)\s*(?:\|\s*|｜\s*|/\s*)(technical\s+skills|professional\s+skills|core\s+competencies|key\s+skills|relevant\s+skills|soft\s+skills|skills\s+overview|programming\s*(?:&|\+|and)\s*development|"
    r"web\s+technologies|backend\s*(?:&|\+|and)\s*databases|frontend\s*(?:&|\+|and)\s*backend|languages?\s*(?:&|\+|and)\s*frameworks|tools\s*(?:&|\+|and)\s*technologies|"
    r"frameworks?\s*(?:&|\+|and)\s*libraries|mobile\s+development|devops|cloud\s+platforms?|skills\s*:|ui/ux\s+implementation|responsive\s+web\s+design)\b"
)
SKILLS_HEADS = [
    "technical skills", "professional skills", "programming & development", "programming and development", "web technologies", "backend & databases", "backend and databases",
    "languages & frameworks", "tools & technologies", "frameworks & libraries", "core competencies", "key skills", "relevant skills", "soft skills", "skills overview",
    "mobile development", "devops", "cloud platforms", "ui/ux implementation", "responsive web design",
]
SKILLS_PART = rf"^(?:{'|'.join(SKILLS_HEADS)})(?: |$)|^technical skills|^skills\s*:"
STUDY_WORD = r"\b(university|college|bachelor|master|diploma|degree|gpa|graduat)\b"
TOOL = r"\b(javascript|typescript|python|react|node\.?js|nestjs|express|html\d?|css|tailwind|mongodb|postgres|sql|aws|azure|docker|kubernetes)\b"
TECHNICAL = r"(?i)\btechnical\s+skills\b"
TECHNICAL_TAIL = r"(?i)[●•·]|\b(javascript|typescript|python|react)\b"
BULLET_TAIL = [r"\b(20\d{2})\b.*[●•·]", r"(?i)[●•·]\s*(JavaScript|TypeScript|Python|React|Node\.?js|HTML|CSS)\b"]
BULLET_START = r"\s*[|｜·]\s*[●•]"
LAST_TECHNICAL = r"(?i)(?:\s*\|\s*)+\s*technical\s+skills\b|\btechnical\s+skills\s*(?:\||\s*●|\s*·)"
LAST_TAIL = r"(?i)\b(javascript|typescript|python|react|programming|nestjs|tailwind)\b"
FIRST_CUT, LAST_CUT = 21, 13
# What speaks for a part that bars set off, and against scraps.
PART_SIGNS = [
    (20.0, r"university|college|institute|school|campus|bachelor|master|b\.?s\b|cgpa|gpa"),
    (7.0, r"\b(19|20)\d{2}\b"),
    (12.0, r"\b(pakistan|india|usa|uae|canada|china|germany|turkey|saudi|egypt|lahore|karachi|islamabad|dubai|london|toronto)\b"),
]
SCRAP_COST, MOST_SCRAP_COST, LONG_PART, LONG_COST, LEAST_SCORE, SCRAP_MEAN = 2.8, 28.0, 220, 6.0, 3.5, 3.55
YEAR = r"\b(19|20)\d{2}\b"
SCHOOL_NAME = r"(?i)^(.*?)\b(college|university|institute|school)\b"
COLLEGE = r"(?i)^(.*?)\bcollege\b"
BARS, EDGES = r"\s*[|｜]\s*", r"[ |—–-]"
#: Parts an overlong line; no line holds it, as it ends one.
CUT = "\n"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def stepwise(c: Column, *steps: Callable[[Column], Column]) -> Column:
    return reduce(let, steps, c)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stripped(c: Column, chars: str = EDGES) -> Column:
    return F.regexp_replace(c, rf"^{chars}+|{chars}+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def letters(w: Column) -> Column:
    return F.length(F.regexp_replace(w, "[^A-Za-z]", ""))


def has_degree(c: Column) -> Column:
    return reduce(lambda a, p: a | F.lower(c).rlike(p), [*cv.DEGREES.values(), DEGREE_WORD], F.lit(False))


def is_noise(c: Column) -> Column:
    """Whether a line (in single spaces) is what profile pages put under education."""
    low = F.lower(c)
    months = (F.length(c) <= LONGEST_MONTHS) & c.rlike(MONTHS_ALONE) & ~low.rlike("university|college|institute|degree|program")
    return (F.length(c) < 2) | c.rlike(NOISE) | months | ((F.length(c) > LONGEST_STORY) & c.rlike(FIRST_PERSON))


def is_skills(part: Column) -> Column:
    t = F.lower(one_line(part))
    return t.rlike(SKILLS_PART) | (t.rlike("[●•·]") & ~t.rlike(STUDY_WORD) & t.rlike(TOOL))


def parts_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, BARS), lambda p: F.trim(p)), lambda p: p != "")


def before_skills(parts: Column) -> Column:
    """The parts before the first that lists skills."""
    at = cv.first_where(parts, is_skills).cast("int")
    return F.when(at > 0, F.slice(parts, F.lit(1), at - 1)).otherwise(parts)


def _until(c: Column, pattern: str) -> Column:
    """What stands before the first match, or null without one."""
    return F.when(c.rlike(pattern), F.split(c, pattern, 2)[0])


def without_noise(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "[\u200b\u200c\u200d\ufeff\u00ad]", ""), F.lit("｜"), F.lit("|"))


def _cut_parts(s: Column) -> Column:
    def shorter(kept: Column) -> Column:
        joined = stripped(F.array_join(kept, " | "))
        return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(parts_of(s))) & (F.length(joined) < F.length(s)), joined).otherwise(s)

    return F.when(F.contains(s, F.lit("|")), let(before_skills(parts_of(s)), shorter)).otherwise(s)


def _behind_skills(s: Column, least: int, tail: str) -> Column:
    """What stands before the words for technical skills, if that is long enough and tools follow; else null."""
    return let(_until(s, TECHNICAL), lambda head: F.when((F.length(head) >= least) & F.substr(s, F.length(head) + 1).rlike(tail), stripped(head, r"[ \t|—–\-/]")))


def without_skills(c: Column) -> Column:
    """The line without skills that run on behind a degree."""
    edges = r"[ \t|—–\-/]"

    def cut(s: Column) -> Column:
        bullets = F.when(s.rlike(BULLET_TAIL[0]) & s.rlike(BULLET_TAIL[1]), stripped(_until(s, BULLET_START), edges))
        return F.coalesce(stripped(_until(s, SKILLS_TAIL), edges), _behind_skills(s, FIRST_CUT, TECHNICAL_TAIL), bullets, F.trim(s))

    return stepwise(c, without_noise, _cut_parts, cut)


def body(lines: Column) -> Column:
    """The lines of the section of education, then lines elsewhere that name a school and are of no other section."""
    schools = F.filter(lines, lambda x: x.rlike(SCHOOL_LINE))

    def joined(own: Column) -> Column:
        known = F.transform(own, lambda x: F.lower(one_line(x)))
        loose = lambda x: (x != "") & ~F.array_contains(known, F.lower(x)) & (F.length(x) <= LONGEST_LOOSE_LINE) & ~x.rlike(LEAK) & (has_degree(x) | (x.rlike(SCHOOL) & (F.length(x) < LONGEST_SCHOOL_LINE)))
        return F.when(F.size(own) > 0, F.concat(F.transform(own, one_line), F.filter(F.transform(schools, one_line), loose))).otherwise(F.transform(schools, one_line))

    return let(cv.section(lines, cv.EDU_HEADING, OWN_SECTIONS), joined)


def sound(items: Column) -> Column:
    """Each line without skills, once, and no noise."""
    return F.array_distinct(F.filter(F.transform(items, without_skills), lambda s: (s != "") & (F.length(s) <= LONGEST_LINE) & ~is_noise(one_line(s))))


def merged(items: Column) -> Column:
    """Neighbours as one entry of which one names a school and the other a degree, the school before the degree.

    The fold carries the line that may still find its other half; a merged
    entry is closed.
    """
    told = F.transform(items, lambda x: F.struct(x.alias("line"), x.rlike(SCHOOL).alias("school"), has_degree(x).alias("degree")))
    none = F.lit(None).cast("struct<line:string,school:boolean,degree:boolean>")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"))
    space = lambda x: one_line(x["line"])

    def step(acc: Column, x: Column) -> Column:
        a = acc["open"]
        ahead, behind = a["school"] & x["degree"] & ~a["degree"], x["school"] & a["degree"] & ~x["degree"]
        pair = F.when(ahead, F.concat(space(a), F.lit(" — "), space(x))).when(behind, F.concat(space(x), F.lit(" — "), space(a)))
        carried = F.struct(acc["done"].alias("done"), x.alias("open"))
        closed = F.struct(F.concat(acc["done"], F.array(pair)).alias("done"), none.alias("open"))
        moved = F.struct(F.concat(acc["done"], F.array(a["line"])).alias("done"), x.alias("open"))
        return F.when(a.isNull(), carried).when(ahead | behind, closed).otherwise(moved)

    return F.aggregate(told, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]["line"]))))


def pieces(line: Column) -> Column:
    """A line over 200 characters at its bullets and semicolons; a piece that is still longer ends with a word and an ellipsis."""
    s = one_line(line)
    cut = F.regexp_replace(F.regexp_replace(s, r"\s*[•·▪▫●○]\s+", CUT), r";\s+([A-Za-z])", f"{CUT}$1")
    found = F.filter(F.transform(F.split(cut, CUT), lambda p: F.trim(p)), lambda p: F.length(p) >= SHORTEST_PIECE)
    short = F.transform(found, lambda p: F.when(F.length(p) > LONGEST_ENTRY, F.concat(F.regexp_replace(F.substring(p, 1, LONGEST_ENTRY - 1), " [^ ]*$", ""), F.lit("…"))).otherwise(p))
    long = let(short, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.substring(s, 1, LONGEST_ENTRY))))
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).when(F.length(s) <= LONGEST_ENTRY, F.array(s)).otherwise(long)


def refined(items: Column) -> Column:
    """At most eight entries, each once, without noise and without long lines of other sections."""
    cut = F.transform(F.flatten(F.transform(F.filter(items, lambda x: ~is_noise(one_line(x))), pieces)), without_skills)
    kept = F.filter(cut, lambda s: (F.trim(s) != "") & ~is_noise(one_line(s)) & ~(s.rlike(LEAK) & (F.length(s) > LONGEST_LEAK)))
    return F.slice(F.array_distinct(F.transform(kept, one_line)), 1, MOST_ENTRIES)


def without_scraps(c: Column) -> Column:
    """A part without what follows a school's name, if that is a row of very short words."""

    def told(seg: Column) -> Column:
        head = F.regexp_extract(seg, SCHOOL_NAME, 0)
        return F.struct(seg.alias("seg"), head.alias("head"), F.length(F.regexp_extract(seg, SCHOOL_NAME, 1)).alias("start"), F.trim(F.substr(seg, F.length(head) + 1)).alias("tail"))

    def cut(x: Column) -> Column:
        sizes = F.filter(F.transform(F.slice(words(x["tail"]), 1, 14), letters), lambda n: n > 0)
        mean = let(sizes, lambda n: F.when(F.size(n) >= 4, F.aggregate(n, F.lit(0), lambda a, b: a + b) / F.size(n)))
        holds = (F.length(x["seg"]) >= 14) & (x["head"] != "") & (x["start"] >= 4) & (F.length(x["tail"]) >= 6) & (F.size(words(x["tail"])) >= 4) & (mean < SCRAP_MEAN)
        return F.when(holds, F.trim(x["head"])).otherwise(x["seg"])

    return stepwise(F.trim(c), told, cut)


def _from_school(p: Column) -> Column:
    """The part from its school's name on, if only scraps of one or two letters stand before."""

    def cut(pre: Column) -> Column:
        scraps = words(F.trim(pre))
        return F.when((F.size(scraps) > 0) & F.forall(scraps, lambda w: letters(w) <= 2), F.trim(F.substr(p, F.length(pre) + 1))).otherwise(p)

    return F.when(p.rlike(SCHOOL_NAME), let(F.regexp_extract(p, SCHOOL_NAME, 1), cut)).otherwise(p)


def _from_college(p: Column) -> Column:
    """The part from the word college on, if most words before have up to three letters."""

    def cut(pre: Column) -> Column:
        before = words(F.trim(pre))
        short = F.size(F.filter(before, lambda w: letters(w) <= 3))
        enough = short >= F.greatest(F.lit(2.0), F.floor(F.size(before) * 0.55) + 0.999)
        return F.when((F.length(pre) > 6) & (F.size(before) > 0) & enough, F.trim(F.substr(p, F.length(pre) + 1))).otherwise(p)

    return F.when(p.rlike(COLLEGE), let(F.regexp_extract(p, COLLEGE, 1), cut)).otherwise(p)


def says_something(p: Column) -> Column:
    """Whether a part names a school, a degree, a year or a place by more than its scraps speak against it."""
    found = F.regexp_extract_all(p, F.lit("[A-Za-z]+"), F.lit(0))
    score = reduce(lambda a, s: a + F.when(F.lower(p).rlike(s[1]), s[0]).otherwise(0.0), PART_SIGNS, F.lit(0.0))
    score -= F.least(F.lit(MOST_SCRAP_COST), F.size(F.filter(found, lambda w: F.length(w) <= 2)) * SCRAP_COST) + F.when(F.length(p) > LONG_PART, LONG_COST).otherwise(0.0)
    return (p != "") & F.when(F.size(found) == 0, p.rlike(YEAR)).otherwise(score >= LEAST_SCORE)


def scrubbed(c: Column) -> Column:
    """Parts between bars that say something; if none does, all of it."""

    def kept(parts: Column) -> Column:
        clean = F.filter(F.transform(before_skills(parts), lambda p: stepwise(p, _from_school, _from_college, without_scraps)), says_something)
        return let(clean, lambda x: F.when((F.size(parts) >= 2) & (F.size(x) > 0), stripped(F.array_join(x, " | "))).otherwise(c))

    return F.when(F.contains(c, F.lit("|")), let(parts_of(without_noise(c)), kept)).otherwise(c)


def finished(items: Column) -> Column:
    """The entries joined by bars, without skills behind them, scraps and bars at the end."""
    edges = r"[ |—–\-/]"
    cut = lambda s: F.coalesce(stripped(_until(s, LAST_TECHNICAL), edges), _behind_skills(s, LAST_CUT, LAST_TAIL), s)
    return stepwise(F.array_join(items, " | "), without_skills, cut, lambda s: stripped(F.regexp_replace(s, r"(\s*\|)+\s*$", ""), edges), scrubbed, without_scraps)
