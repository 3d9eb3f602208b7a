"""Names of persons in the first lines of résumé texts, in e-mail addresses, file names and profile links.

Every guess is a struct of score and name in an array, so that all of it stays
column expressions of a row: no shuffle, no Python. Null texts count as empty,
and no name is the empty string.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions.text import WHITE

# How many of the first lines each kind of guess looks at, and its score.
MOST_LINES, SPACED_LINES, LABEL_LINES, PART_LINES, LETTER_LINES, CONTACT_LINES = 40, 8, 35, 28, 15, 10
LABEL_SCORE, OWNER_SCORE, PART_SCORE, PREFIX_BONUS, CONTACT_BONUS, PLACE_BONUS, LETTER_SCORE, CONTACT_SCORE = 100, 95, 80, 10, 12, 6, 40, 42
LEAST_SCORE = 35
MOST_SPLITS, LONGEST_PART, LONGEST_CONTACT_PART = 24, 88, 220

# How lines end and header lines are parted.
LINE_END = "[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
INVISIBLE_SIGNS = ["\u200b", "\u200c", "\u200d", "\ufeff", "\u00ad"]
INVISIBLE = f"[{''.join(INVISIBLE_SIGNS)}]+"
PART_END = "[|•·\u200b\u200c\u200d\ufeff\u00ad]+|\t+| {3,}"
# How a name is labelled, at the start of a line and within it, and how a text names its owner.
LABEL = r"(?i)^\s*(?:full\s*name|name|candidate(?:\s+name)?)\s*[:;]\s*(.+?)\s*$"
LABEL_WITHIN = r"(?i)(?:full\s*name|name|candidate(?:\s+name)?)\s*[:;]\s*([A-Za-z][A-Za-z .'-]{1,60}?)(?:\s*[|,]|\s*(?:city|phone|email|address|contact)\b|$)"
OWNER = r"(?:this\s+resume\s+(?:belongs\s+to|is\s+of)|resume\s+of|prepared\s+by)\s*[:\-–—]*\s*[—–\-]*\s*([A-Za-z][A-Za-z .'-]{3,50}?)\s*[—–\-]*\s*$"
# Signs of an address or a telephone in a line. One character before the @ is as good as all.
CONTACT = r"(?i)[\w.+-]@[\w.-]+\.\w|linkedin\.com|github\.com|http|\[e-?mail\]|\[email\s*address\]"
#: A telephone has so many digits and signs in a row, or stands in brackets.
PHONE_GLANCE = r"\[|\d[\d\s().-]{7,}\d"
PHONE = r"(?i)\b\+?\d[\d\s().-]{7,}\d\b|\[phone\]|\[tel\]|\[mobile\]|\[contact\]|\[cell\]|\[number\]"
MAILBOX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}"
MAIL_LABEL = r"(?i:E-?\s*mails?\s*:\s*)"
CONTACT_LABEL_END = r"(?i)\s+(?:e-?mail|email|phone|tel|mobile|cell|whatsapp)\s*:\s*$"
LONG_PHONE = r"\+?\d[\d\s().-]{7,32}\d(?:\s|$)"
# Lines and words that are no name.
NO_NAME_LINE = r"(?i)\b(resume|curriculum vitae|\bcv\b|page\s+\d|confidential|table of contents|professional\s+summary|summary|objective|about\s+me)\b"
NO_LETTER_LINE = ["resume", "curriculum vitae", "cv", "contact", "profile", "summary", "objective"]
NO_VALUE = ["candidate", "unknown candidate", "unknown"]
CREDENTIAL = r"(?i)\b(certified|certification|certifications|certificate|certificates|credential|credentials|license|licence|licensed|licenced|badge|badges)\b"
HONORIFIC = r"(?i)^\s*(?:mr\.?|mrs\.?|ms\.?|miss|dr\.?|prof\.?|eng\.?|engr\.?)\s+"
ROLES = [
    "engineer", "developer", "designer", "analyst", "scientist", "manager", "specialist", "consultant", "officer", "executive", "lead", "intern", "associate", "architect",
    "tester", "qa", "sqa", "director", "coordinator", "administrator", "programmer",
]
TITLE = (
    r"\b((?:senior|sr\.?|junior|jr\.?|lead|principal|assistant)?\s*"
    r"(?:software|backend|frontend|full\s*stack|fullstack|web|mobile|android|ios|data|ml|ai|qa|sqa|ui/ux|ux/ui|ui|ux)?\s*"
    r"(?:engineer|developer|designer|analyst|scientist|manager|tester|intern|architect))\b"
)
DOMAIN_TITLE = (
    r"\b(finance|financial|business|data|product|marketing|credit|investment|tax|budget|revenue|operations|information|technical|staff|project|program|account|sales|customer|supply|"
    r"quality|risk|policy|hr|it)\s+(analyst|associate|consultant|specialist|coordinator|administrator)\b"
)
PHRASES = [
    "time management", "project management", "stress management", "change management", "risk management", "artificial intelligence", "machine learning", "deep learning",
    "data science", "computer science", "information technology", "business analysis", "business analyst", "quality assurance", "customer service", "human resources",
    "supply chain", "public relations", "financial analysis", "operations management", "product management", "sales management", "aws certified", "azure certified",
    "google certified", "frontend and backend teams", "frontend and backend team", "backend and frontend teams", "backend and frontend team",
]
TOPICS = [
    "software", "technologies", "technology", "solutions", "systems", "consulting", "services", "management", "intelligence", "learning", "science", "sciences", "analytics",
    "automation", "development", "engineering", "frontend", "backend", "fullstack", "full-stack", "team", "teams", "database", "databases", "security", "networking", "network",
    "application", "applications", "enterprise", "digital", "cloud", "data", "machine", "artificial", "professional", "technical", "certification", "certifications",
    "certified", "certificate", "certificates", "credential", "credentials", "license", "licence", "licensed", "licenced", "badge", "badges", "university", "college",
    "institute", "international", "corporation", "incorporated", "limited", "partners", "group", "laboratory", "laboratories", "labs", "pvt", "ltd", "llc", "inc", "corp", "plc",
    "global", "national", "regional", "marketing", "sales", "operations", "strategy", "research", "experience", "skills", "education", "summary", "objective", "profile",
    "programming", "framework", "frameworks", "testing", "assurance", "computer", "resource", "resources", "communications", "media", "financial", "accounting", "design",
    "designer", "architecture", "infrastructure", "devops", "agile", "scrum",
    "converting", "developing", "managing", "achieving", "handling", "leading", "building", "implementing", "driving", "supporting", "delivering", "ensuring", "maintaining",
    "creating", "improving", "overseeing", "preparing", "assisted", "achieved", "responsible", "collaborated", "coordinated", "clients", "vendors", "stakeholders", "targets",
    "pipelines",
]
# What is cut from the end of a name, places before words of titles.
PLACES = [
    "lahore", "karachi", "islamabad", "rawalpindi", "faisalabad", "multan", "peshawar", "quetta", "sialkot", "gujranwala", "hyderabad", "pakistan", "india", "uae", "dubai",
    "riyadh", "jeddah", "uk", "usa", "canada",
]
TITLE_WORDS = [
    "data", "machine", "artificial", "digital", "senior", "junior", "lead", "principal", "chief", "head", "product", "business", "content", "cloud", "cyber", "network", "system",
    "project", "supply", "chain", "human", "resources", "resource", "financial", "graphic", "software", "mobile", "android", "ios", "web", "fullstack", "backend", "frontend",
]
# Addresses of no person, and what file names end in.
OFFICES = [
    "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster", "bounce", "support", "help", "helpdesk", "hello", "team", "admin", "info", "contact", "sales",
    "careers", "jobs", "hr", "recruiting", "newsletter", "notifications", "notification",
]
FILE_WORDS = [
    "resume", "cv", "curriculum", "final", "draft", "updated", "new", "v1", "v2", "v3", "pdf", "docx", "doc", "txt", "untitled", "document", "file", "profile", "copy", "sample",
    "samples", "test", "testing", "example", "finance", "hr", "ops", "operations", "tech", "dev", "ui", "ux", "sales", "marketing", "admin", "it", "engineering", "accounts",
    "account", "design", "data", "devops", "qa", "sqa", "product", "manager", "analyst", "executive",
]
NO_FILE = r"(?i)\b(resume|cv|curriculum|résumé|linkedin|profile|untitled|document|file)\b"
#: A letter that is no capital.
NOT_CAPITAL = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
LONGEST_STEM, LONGEST_LOCAL, MOST_LOCAL_WORDS = 56, 64, 4
GUESSES = "array<struct<score:int,name:string>>"


def _u(pattern: str) -> str:
    """The pattern with words, digits and white space of all scripts."""
    return "(?U)" + pattern


def _strip(c: Column, signs: str = "") -> Column:
    """Without white space of all scripts, and these signs, at both ends. Only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE + signs))


def _through(items: Column, *steps: Callable[[Column], Column]) -> Column:
    """An array's items through one step after another, each of which may name its input often."""
    return reduce(F.transform, steps, items)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, _u(r"\s+")), lambda w: w != "")


def normalised(raws: Column) -> Column:
    """Of an array of structs of score and raw text, those that are written as names, as score and name.

    Two to six words of letters, without title or remark, a single comma turned
    around, places and titles cut from the end, capitals made small.
    """

    def may_be(raw: Column) -> Column:
        # A title and a sign at the end may go, so eight words can become six; other signs go in brackets alone.
        return F.contains(raw, F.lit("(")) | raw.rlike(_u(r"^(?!\s*+(?:\S++\s++){8}\S)[\p{L}\s'’.,•|·-]*+$"))

    def with_raw(x: Column, raw: Column) -> Column:
        return F.struct(x["score"].alias("score"), raw.alias("raw"))

    def turned(x: Column) -> Column:
        halves = F.transform(F.split(x["raw"], ","), lambda h: _strip(h))
        return with_raw(x, F.when((F.size(halves) == 2) & ~F.array_contains(halves, ""), F.concat(halves[1], F.lit(" "), halves[0])).otherwise(x["raw"]))

    def parted(x: Column) -> Column:
        bare = _strip(F.regexp_replace(F.regexp_replace(x["raw"], _u(r"\s*\([^)]{0,80}\)\s*$"), ""), r"\s*[•|·]+$", ""))
        return F.struct(x["score"].alias("score"), _words(bare).alias("parts"))

    def is_word(w: Column) -> Column:
        return w.rlike(r"^(?=.*\p{L})(?!(?:[^.]*\.){2})[\p{L}'’.-]+$") & ~w.rlike(r"^(?:(?i:jr|sr)|\p{L}['’-])$")

    def cut(x: Column) -> Column:
        last = F.array_max(F.transform(x["parts"], lambda w, i: F.when(F.lower(w).isin([*PLACES, *ROLES, *TITLE_WORDS]), 2).otherwise(F.greatest(i + 1, F.lit(2)))))
        return F.struct(x["score"].alias("score"), x["parts"].alias("parts"), F.array_join(F.slice(x["parts"], F.lit(1), last), " ").alias("name"))

    def no_acronym(x: Column) -> Column:
        return ~x["name"].rlike(r"\p{Ll}") | ~F.exists(x["parts"], lambda w: w.rlike(r"^[^\p{L}.]*(?:\p{Lu}[^\p{L}.]*){2,4}$"))

    def shown(x: Column) -> Column:
        small = F.array_join(F.transform(F.split(x["name"], " "), lambda w: F.when((F.length(w) <= 2) & w.endswith("."), w).otherwise(_capital(w))), " ")
        return F.struct(x["score"].cast("int").alias("score"), F.when(x["name"].rlike(NOT_CAPITAL), x["name"]).otherwise(small).alias("name"))

    clean = _through(F.filter(raws, lambda x: may_be(x["raw"])), lambda x: with_raw(x, F.regexp_replace(_strip(x["raw"]), HONORIFIC, "")), turned, parted)
    written = F.filter(clean, lambda x: F.size(x["parts"]).between(2, 6) & F.forall(x["parts"], is_word))
    return F.transform(F.filter(F.transform(written, cut), no_acronym), shown)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


def is_job_title(c: Column) -> Column:
    low = F.trim(F.lower(c))
    title, words = F.length(F.regexp_extract(low, TITLE, 0)), F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    roles = F.size(F.filter(words, lambda w: w.isin(ROLES)))
    return (low == "") | low.rlike(DOMAIN_TITLE) | ((title > 0) & (title >= F.least(F.length(low) * 0.65, F.length(low) - 2))) | (roles >= 2) | ((roles >= 1) & (F.size(words) >= 4))


def is_topic(c: Column) -> Column:
    """Whether it is a skill, a subject or a firm, or has no Latin letter."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    return _words(low).isNull() | F.array_join(_words(low), " ").isin(PHRASES) | (F.size(words) == 0) | F.exists(words, lambda w: w.isin(TOPICS))


def is_scrap(c: Column) -> Column:
    """Whether it looks like what a scan leaves: a lone small letter, or three and more words of under four letters."""
    parts = F.split(c, " ")
    short = ~F.exists(parts, lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 4)
    return c.rlike(r"(?:^| )\p{Ll}(?: |$)") | ((F.size(parts) >= 3) & c.rlike(r"\p{Ll}") & short)


def is_person(c: Column) -> Column:
    return (c != "") & ~F.lower(c).isin(NO_VALUE) & ~is_scrap(c) & ~c.rlike(CREDENTIAL) & ~is_job_title(c) & ~is_topic(c)


def persons(raws: Column) -> Column:
    """Of an array of structs of score and raw text, the names of persons."""
    return F.filter(normalised(raws), lambda x: is_person(x["name"]))


def _unspaced(line: Column) -> Column:
    """Words whose letters stand apart, if words stand further apart, in each part of a line."""

    def joined(piece: Column) -> Column:
        words = _words(piece)
        letters = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
        return F.when((F.size(words) >= 3) & (letters >= F.greatest(F.lit(3), F.floor(F.size(words) * 0.55))), F.array_join(words, "")).otherwise(piece)

    def part(p: Column) -> Column:
        pieces = F.split(p, _u(r"\s{2,}"))
        return F.when((F.length(p) < 5) | (F.size(pieces) < 2), p).otherwise(F.array_join(F.transform(pieces, joined), " "))

    parts = F.filter(F.split(line, _u(r"\s*\|\s*")), lambda p: p != "")
    plain = (F.length(line) < 5) | ~line.rlike(_u(r"\||\s\s"))
    return F.when(plain, line).otherwise(F.array_join(F.transform(parts, part), " | "))


def laid_out(text: Column) -> Column:
    """The text with its fields as lines: invisible characters part fields, and where lines were lost, bars do."""
    t = _strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    return F.when(reduce(lambda a, sign: a | F.contains(t, F.lit(sign)), INVISIBLE_SIGNS, F.lit(False)), F.regexp_replace(t, INVISIBLE, " | ")).otherwise(t)


def unfolded(t: Column) -> Column:
    lost = (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) < 4) & F.contains(t, F.lit("|"))
    return F.when(lost, F.array_join(F.split(t, _u(r"\s*\|\s*"), MOST_SPLITS + 1), "\n")).otherwise(t)


def first_lines(t: Column) -> Column:
    return F.slice(F.filter(F.transform(F.split(t, LINE_END), lambda x: _strip(x)), lambda x: x != ""), 1, MOST_LINES)


def mended_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.when(i < SPACED_LINES, _unspaced(x)).otherwise(x))


def has_contact(c: Column) -> Column:
    """Whether there is an address or a telephone; lines without the signs of one are told by a glance."""
    signs = F.contains(c, F.lit("@")) | F.contains(c, F.lit("[")) | F.contains(F.lower(c), F.lit("http")) | F.contains(F.lower(c), F.lit(".com"))
    return (signs & c.rlike(_u(CONTACT))) | (c.rlike(_u(PHONE_GLANCE)) & c.rlike(_u(PHONE)))


def before_contact(c: Column) -> Column:
    """What stands before an address, its label, a profile link or a telephone: the first of these that leaves 3 to 120 characters."""
    edge = ",|•–-"
    mailbox = _strip(F.regexp_replace(_strip(F.regexp_extract(c, rf"^(.*?)(?<![A-Za-z0-9._%+-]){MAILBOX.replace('+@', '++@')}", 1), edge), CONTACT_LABEL_END, ""), edge)
    label = _strip(F.regexp_extract(c, rf"^(.*?){MAIL_LABEL}", 1), "|·•,;–-")
    link = _strip(F.regexp_extract(c, r"(?i)^(.*?)linkedin\.com/", 1), ",|·•–-")
    phone = F.when(c.rlike(_u(LONG_PHONE)), F.regexp_extract(c, _u(rf"^(.*?){LONG_PHONE}"), 1)).otherwise(F.regexp_extract(c, _u(rf"^(.*?)(?:{PHONE.removeprefix('(?i)')})").replace("(?U)", "(?iU)"), 1))
    phone = F.regexp_replace(phone, r"[\s,;:|·•–-]+$", "")
    return F.element_at(F.concat(F.filter(F.array(mailbox, label, link, phone), lambda x: F.length(x).between(3, 120)), F.array(F.lit(""))), 1)


def _guess(score: Column, raw: Column) -> Column:
    return F.struct(score.cast("int").alias("score"), raw.alias("raw"))


def labelled(lines: Column) -> Column:
    """Guesses by a label, the earlier the better."""

    def value(x: Column) -> Column:
        whole = F.regexp_extract(x, _u(LABEL), 1)
        said = F.split(F.when(whole != "", whole).otherwise(F.regexp_extract(x, _u(LABEL_WITHIN), 1)), r"\|")[0]
        return F.when(F.contains(x, F.lit(":")) | F.contains(x, F.lit(";")), said).otherwise("")

    return F.transform(F.slice(lines, 1, LABEL_LINES), lambda x, i: _guess(LABEL_SCORE - i, value(x)))


def in_parts(lines: Column) -> Column:
    """Guesses by the parts of header lines; a part with an address counts by what stands before that."""

    def parts(x: Column) -> Column:
        cut = F.filter(F.transform(F.split(x["line"], PART_END), lambda p: _strip(p)), lambda p: p != "")
        return F.transform(cut, lambda p, j: F.struct(p.alias("part"), (x["score"] + F.greatest(F.lit(0), PLACE_BONUS - 2 * j)).alias("score")))

    def line(x: Column, i: Column) -> Column:
        return F.struct(x.alias("line"), (PART_SCORE - 2 * i + F.when(has_contact(x), CONTACT_BONUS).otherwise(0)).alias("score"))

    def guess(x: Column) -> Column:
        prefix = before_contact(x["part"])
        return F.when(has_contact(x["part"]), _guess(x["score"] + PREFIX_BONUS, F.when(F.length(prefix) <= 100, prefix).otherwise(""))).otherwise(_guess(x["score"], x["part"]))

    header = F.filter(F.transform(F.slice(lines, 1, PART_LINES), line), lambda x: ~x["line"].rlike(_u(NO_NAME_LINE)))
    found = F.flatten(F.transform(header, parts))
    wide = lambda p: F.contains(p, F.lit("@")) | F.contains(F.lower(p), F.lit("mail"))
    return F.transform(F.filter(found, lambda x: F.length(x["part"]) <= F.when(wide(x["part"]), LONGEST_CONTACT_PART).otherwise(LONGEST_PART)), guess)


def of_letters(lines: Column) -> Column:
    """Guesses by lines of letters alone."""

    def value(x: Column) -> Column:
        said = reduce(lambda a, w: a | F.contains(F.lower(x), F.lit(w)), NO_LETTER_LINE, F.lit(False))
        plain = x.rlike(_u(r"^[\p{L}\s'-]{3,70}$")) & ~F.contains(x, F.lit("\t")) & ~said
        parts = _words(F.replace(x, F.lit("-"), F.lit(" ")))
        return F.when(plain & F.size(parts).between(2, 5), F.array_join(parts, " ")).otherwise("")

    return F.transform(F.slice(lines, 1, LETTER_LINES), lambda x, i: _guess(LETTER_SCORE - i, value(x)))


def owner(t: Column) -> Column:
    """The guess by a text that says whose it is, wherever that stands."""
    # A long s counts as an s where case does not matter.
    signs = reduce(lambda a, w: a | F.contains(F.lower(t), F.lit(w)), ["resume", "re\u017fume", "prepared"], F.lit(False))
    return F.array(_guess(F.lit(OWNER_SCORE), F.when(signs, F.regexp_extract(t, _u(OWNER).replace("(?U)", "(?imdU)"), 1)).otherwise("")))


def beside_contact(lines: Column) -> Column:
    """Guesses by what stands before an address in a whole line, where nothing else is found."""

    def value(x: Column) -> Column:
        prefix = before_contact(x)
        return F.when(F.length(prefix) <= 100, prefix).otherwise("")

    return F.transform(F.slice(lines, 1, CONTACT_LINES), lambda x, i: _guess(CONTACT_SCORE - i, value(x)))


def best(guesses: Column) -> Column:
    """The name of the highest score, of equal ones the first by its letters; empty below the least score."""
    first = F.array_min(F.transform(guesses, lambda x: F.struct((-x["score"]).alias("down"), x["name"].alias("name"))))
    return F.coalesce(F.when(first["down"] <= -LEAST_SCORE, first["name"]), F.lit(""))


def _one(raw: Column) -> Column:
    return F.array(_guess(F.lit(0), raw))


def _kept_words(words: Column, ends: list[str]) -> Column:
    """Words without those at the end that are in the list, digits and points behind them aside."""
    last = F.array_max(F.transform(words, lambda w, i: F.when(F.regexp_replace(F.lower(w), r"[0-9.]+$", "").isin(ends), 0).otherwise(i + 1)))
    return F.slice(words, F.lit(1), F.coalesce(last, F.lit(0)))


def from_address(address: Column) -> Column:
    """A name by an e-mail address of two or more words, of which the first four count."""
    low = _strip(F.lower(F.coalesce(address, F.lit(""))))
    local = _strip(F.split(_strip(F.split(low, "@", 2)[0]), r"\+", 2)[0])
    words = F.filter(F.transform(F.split(local, "[._-]+"), lambda w: F.regexp_replace(w, r"\d+$", "")), lambda w: w.rlike(r"^\p{L}{2,}$"))
    name = F.array_join(F.transform(F.slice(words, 1, MOST_LOCAL_WORDS), _capital), " ")
    sound = F.contains(low, F.lit("@")) & (F.length(local) <= LONGEST_LOCAL) & ~local.isin(OFFICES) & (F.size(words) >= 2)
    return F.when(sound & ~is_job_title(name) & ~is_topic(name) & ~name.rlike(CREDENTIAL), name).otherwise("")


def from_file_stem(stem: Column) -> Column:
    """A name by a file's name without its ending, if it says nothing of a résumé but at its end."""
    s = _strip(F.coalesce(stem, F.lit("")))
    words = _words(F.regexp_replace(s, "[_-]+", " "))
    kept = _kept_words(words, FILE_WORDS)
    said = F.array_join(kept, " ")
    sound = (s != "") & (F.length(s) <= LONGEST_STEM) & ~s.rlike(_u(NO_FILE)) & ~s.rlike(_u(r"^[\d\s._-]+$")) & ~F.coalesce(F.get(words, F.lit(0)).rlike(r"^\d+$"), F.lit(False))
    sound &= (F.size(kept) >= 2) & ~is_job_title(said) & ~is_topic(said) & ~said.rlike(CREDENTIAL)
    name = F.get(F.filter(normalised(_one(said)), lambda x: ~is_job_title(x["name"])), F.lit(0))["name"]
    return F.when(sound, F.coalesce(name, F.lit(""))).otherwise("")


def from_file_name(name: Column) -> Column:
    """A file's name without folders and ending, for display."""
    base = F.regexp_replace(F.regexp_replace(_strip(F.coalesce(name, F.lit(""))), "/+$", ""), r"^.*/", "")
    return _strip(F.replace(F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""), F.lit("_"), F.lit(" ")))


def from_profile_slug(slug: Column) -> Column:
    """The words of a profile link's last part, without the key behind them; what can't be decoded stays as it is."""
    raw = _strip(F.coalesce(slug, F.lit("")))
    s = _strip(F.coalesce(F.replace(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%20"))), F.lit("+"), F.lit(" ")), raw))

    def is_key(w: Column) -> Column:
        return w.rlike(r"^[a-zA-Z0-9]{6,20}$") & (w.rlike(r"^(?i)[a-f0-9]{6,12}$") | w.rlike(r"\d"))

    parts = F.filter(F.transform(F.split(s, "-"), lambda p: _strip(p)), lambda p: p != "")
    words = F.flatten(F.transform(parts, _words))
    last = F.array_max(F.transform(words, lambda w, i: F.when(is_key(w), 1).otherwise(i + 1)))
    return F.when(F.size(words) == 0, s).otherwise(F.array_join(F.slice(words, F.lit(1), F.coalesce(last, F.lit(0))), " "))
