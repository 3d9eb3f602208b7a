"""Free résumé text: its sections, degree, certificates, chunk roles and e-mail address.

Lines are arrays, a section is a slice of them, and all of it stays column
expressions. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions.text import EMAIL, PHONE, URL

# What may stand before a heading, and the headings.
LEAD = r"^\s*(?:[•‣●○·\*\-–]|\d{1,2}[.)]\s*)?\s*"
HEADING = LEAD + r"(education|academic|certifications?|certification|skills|projects?|publications?|languages?|awards?|references?|interests?|summary|profile|objective|about|contact)\b"
CERT_HEADING = LEAD + r"(?:certifications?|professional certifications?|licenses?|credentials?)\b\s*:?\s*$"
EDU_HEADING = LEAD + r"(?:education|educational background|academic background|academic qualifications|qualifications)\b\s*:?\s*$"
MOST_LINES, LONGEST_LINE = 24, 500
# Degrees from the highest down.
DEGREES = {
    "phd": r"\bph\.?d\b|\bdoctorate\b",
    "master": r"\bmaster\b|\bm\.?s\b|\bm\.?sc\b|\bmba\b|\bm\.?phil\b",
    "bachelor": r"\bbachelor\b|\bb\.?s\b|\bbs\b|\bb\.?sc\b|\bbe\b|\bbeng\b|\bba\b",
    "intermediate": r"\bintermediate\b|\bfsc\b|\bics\b|\ba-?levels\b",
    "matric": r"\bmatric\b|\bssc\b|\bo-?levels\b",
}
# Lines that name a certificate.
CERT_WORD = r"\b(certification|certified|certificate)\b"
CERT_VENDOR = r"\b(aws|azure|gcp|google cloud)\b.{0,80}\b(associate|professional|specialty|practitioner|foundations|expert|developer)\b"
CERT_NAME = r"\b(pmp|capm|prince2|psm\s*(?:i{1,3}|\d)|pspo|csm|cspo|cissp|cisa|cism|sscp|crisc|ceh|ccna|ccnp|ccie|cka|cks|ckad|rhcsa|rhce|lfcs|itil\s*(?:v?\d|foundation|practitioner)?|comptia\s+(?:security|network|a)\+|aws\s+certified|google\s+professional|microsoft\s+certified)\b"
CERT_LEAK = r"\b(work experience|employment history|education\s*:|education\s+background)\b"
CERT_JOB = r"\b(engineer|developer|manager|director|analyst|scientist|architect|consultant)\b"
CERT_SAID = r"\b(certified|certification|credential|exam|badge|license)\b"
MOST_CERTS = 14
# What speaks for a chunk's role, and by how much; all patterns of an entry have to match.
CHUNK_ROLES = ["header", "about", "experience", "education", "skills", "certifications", "other"]
CHUNK_SIGNS = [
    ("about", 4.0, [r"\b(summary|about me|overview|mission|passionate|i love to|i enjoy|professional with)\b"]),
    ("about", 1.0, [r"\b(honors|awards|publications|volunteer)\b"]),
    ("skills", 3.5, [r"(?m)^skills?\s*$|\b(technical skills|core competencies|expertise in|industry knowledge|tools\s*&\s*technologies)\b"]),
    ("skills", 2.5, [r"\b\d+\s+endorsements?\b"]),
    ("skills", 2.0, [r"\b(python|java|react|angular|vue|node|sql|aws|gcp|azure|kubernetes|docker|typescript|javascript|machine learning|data science)\b"]),
    ("education", 4.0, [r"\b(university|college|bachelor|master|ph\.?d|doctorate|diploma|degree|gpa|graduated|thesis|academic)\b"]),
    ("experience", 3.5, [r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b.*\b20\d{2}\b|\b(20\d{2}\s*[–-]\s*(20\d{2}|present))\b|\b(full[\s-]?time|part[\s-]?time|contract|internship|employment)\b"]),
    ("experience", 2.0, [r"\b(@\s*\w+| at \w+ inc| llc| ltd|corp\.|company)\b"]),
    ("experience", 1.5, [r"\b(years?\s+of\s+experience|yoe\b|managed team|led a team|built|shipped|delivered)\b"]),
    ("experience", 3.0, [r"\b20\d{2}\s*[–-]\s*(20\d{2}|present)\b", r"\b(full|part)[\s-]?time|contract|internship|freelance|@| at [a-z0-9]"]),
    ("experience", 2.5, [r"\b(designer|developer|engineer|lead|manager|consultant|analyst)\s+at\s+\w"]),
    ("certifications", 4.0, [r"\b(certified|certificate|license|credential|pmp|aws certified|scrum master|clearance)\b"]),
]
LEAST_SCORE, SHORTEST_CHUNK, MOST_CHUNKS = 1.2, 15, 400
# How an address is written, labelled, and which is no person's.
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LABELLED = r"(?im)(?:^|[\n\r;|])(?:e[-_]?mail|e\s*mail|contact)\s*[:=#]\s*(" + ADDRESS + ")"
MAILTO = r"(?i)mailto:(" + ADDRESS + ")"
TOKEN = r"\b([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9][A-Za-z0-9.-]{0,120}\.[A-Za-z]{2,24})\b"
NOBODY = r"(?i)noreply|no[-_]?reply|donotreply|mailer-daemon|notifications?@|bounce|@example\.(com|org)\b"
PUBLIC_HOSTS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "protonmail.com", "icloud.com"]
#: Hosts that scanned texts give without an at sign, their letters as they may stand apart, in the order of their repair.
SPACED_HOSTS = {"gmail.com": "g mail", "outlook.com": "o u t l o o k", "hotmail.com": "h o t m a i l", "yahoo.com": "y a h o o", "protonmail.com": "p r o t o n m a i l", "icloud.com": "i c l o u d"}
#: What ends the head of a text, and what tells that a line holds an address or its host.
HEAD_END = r"(skills|technical\s+skills|experience|work\s+experience|education|projects|summary|objective)\b"
HOST_LINE = r"(?i)@|\b(gmail|yahoo|hotmail|outlook|protonmail|icloud|edu\.pk|ac\.uk|com\.pk)\b|\b[A-Za-z0-9][A-Za-z0-9._-]{0,48}\.(?:com|net|org|io|co|edu|pk|uk|jobs|dev)\b"
MAILBOX, HEAD_LINES, ADDRESS_LINES, LONGEST_MAILBOX = r"^[\w.%+-]+$", 40, 6, 72
HEAD, LONGEST_ADDRESS, ROUNDS = 12_000, 320, 8
#: What no repair removes or reaches across, and no address or its label holds: a text falls apart at these for the search.
STOPS = "[,;!?\"'<>{}/\\\\$&*~^`]"
#: The repairs that are done again and again, and what matches if one of them does.
REJOINED = [(r"([\w.%+-])\s+([\w.%+-])\s*@", "$1$2@"), (r"@\s*([\w.-])\s+([\w.-])", "@$1$2"), (r"([\w.%+-])\s+\.\s+([\w.%+-])", "$1.$2"), (r"(?i)(\.[a-z]{2,})\s+\.", "$1.")]
BROKEN = r"(?<=[\w.%+-])\s+(?:[\w.%+-]\s*@|\.)|@\s*[\w.-]\s+[\w.-]"
#: Without one of these in a text, repairs bring no at sign into it: repairs take out spaces, never letters.
ANCHOR = r"(?i)@|[\[(]\s*at\s*[\])]|" + "|".join(r"\s*".join(host.removesuffix(".com")) for host in PUBLIC_HOSTS)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(c: Column) -> Column:
    """The lines that are not empty, trimmed."""
    return F.filter(F.transform(F.split(unix_lines(c), "\n"), trimmed), lambda x: x != "")


def first_where(items: Column, holds) -> Column:
    """The place, from 1, of the first item for which a condition holds; 0 if none."""
    return F.array_position(F.transform(items, lambda x: F.coalesce(holds(x), F.lit(False))), True)


def section(items: Column, heading: str, own: list[str]) -> Column:
    """The lines after the first heading up to the next one of another section, at most 24, or up to a very long line."""
    at = first_where(items, lambda x: F.lower(x).rlike(heading))
    rest = F.slice(items, at.cast("int") + 1, F.size(items))
    other = lambda x: F.lower(x).rlike(HEADING) & ~F.regexp_extract(F.lower(x), HEADING, 1).isin(own)
    end = first_where(rest, lambda x: other(x) | (F.length(x) > LONGEST_LINE))
    return F.when(at > 0, F.slice(rest, 1, F.least(F.when(end > 0, end - 1).otherwise(MOST_LINES), F.lit(MOST_LINES)).cast("int"))).otherwise(F.array().cast("array<string>"))


def highest_degree(c: Column) -> Column:
    """The highest degree that the text names, none being empty."""
    out = F.lit("")
    for name, pattern in reversed(DEGREES.items()):
        out = F.when(F.lower(F.coalesce(c, F.lit(""))).rlike(pattern), name).otherwise(out)
    return out


def _named_certificate(x: Column) -> Column:
    t, n = F.lower(x), F.length(x)
    wrong = (t.rlike(CERT_LEAK) & (n > 50)) | (t.rlike(CERT_JOB) & (n > 55))
    return n.between(2, 160) & t.rlike(CERT_NAME) & ~wrong & (t.rlike(CERT_SAID) | (n <= 52))


def certifications(items: Column) -> Column:
    """Lines of the section of certificates, then lines that name one: each once, at most 14, joined by bars."""
    named = F.filter(items, lambda x: F.lower(x).rlike(CERT_WORD) | F.lower(x).rlike(CERT_VENDOR) | _named_certificate(x))
    found = F.transform(F.concat(section(items, CERT_HEADING, ["certifications", "certification"]), named), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    return F.array_join(F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) <= 400)), 1, MOST_CERTS), " | ")


def strip_pii_lines(c: Column) -> Column:
    """As strip_pii, but lines stay lines. A blank text is returned as it is."""
    t = unix_lines(c)
    for pattern, name in ((EMAIL, "EMAIL"), (PHONE, "PHONE"), (URL, "URL")):
        t = F.regexp_replace(t, pattern, f" [{name}] ")
    kept = F.transform(F.split(t, "\n"), lambda x: trimmed(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.when(trimmed(F.coalesce(c, F.lit(""))) == "", F.coalesce(c, F.lit(""))).otherwise(trimmed(F.array_join(kept, "\n")))


def chunks(c: Column) -> Column:
    """Paragraphs of over 15 characters, at most 400; a line that begins with a month and a year begins one. A text without any is one chunk.

    A long text with hardly any paragraphs is not cut further.
    """
    t = unix_lines(c)
    cut = F.filter(F.transform(F.split(t, r"\n{2,}|\n(?=\s{0,3}[A-Z][a-z]+ \d{4})"), trimmed), lambda x: F.length(x) > SHORTEST_CHUNK)
    whole = F.when(F.length(trimmed(t)) > SHORTEST_CHUNK, F.array(trimmed(t))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.when(F.size(cut) > 0, cut).otherwise(whole), 1, MOST_CHUNKS)


def chunk_role(chunk: Column) -> Column:
    """The role with the highest score, the first of equal ones; other under 1.2 or 12 characters. about gives way to clearly stronger signs."""
    low = F.lower(chunk)
    score = dict.fromkeys(CHUNK_ROLES, F.lit(0.0))
    score["other"] = F.lit(0.01)
    score["header"] = F.when((F.length(chunk) <= 100) & ~F.contains(chunk, F.lit("\n")), 2.5).otherwise(0.0)
    for role, weight, patterns in CHUNK_SIGNS:
        seen = F.lit(True)
        for pattern in patterns:
            seen = seen & low.rlike(pattern)
        score[role] = score[role] + F.when(seen, weight).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(score[r].alias("score"), F.lit(-i).alias("place"), F.lit(r).alias("role")) for i, r in enumerate(CHUNK_ROLES)]))
    settled = F.when(best["role"] != "about", best["role"])
    for rival in ("experience", "skills", "education", "certifications"):
        settled = settled.when(score[rival] > score["about"] + 0.5, rival)
    return F.when((F.length(chunk) < 12) | (best["score"] < LEAST_SCORE), "other").otherwise(settled.otherwise("about"))


GAP = r"[^\S\n]"


def host_alone(host: str) -> str:
    """A host by letters that may stand apart, behind a space."""
    letters = f"{GAP}*".join(SPACED_HOSTS[host].split())
    return rf"(?i){GAP}{letters}(?:\.|{GAP})+c{GAP}*o{GAP}*m\b"


def spaced_host(host: str) -> str:
    """A mailbox, possibly in pieces, and a host whose at sign is lost, on one line."""
    return rf"(?i)([a-z0-9](?:[a-z0-9._%+-]|{GAP}+[a-z0-9._%+-]){{0,52}}){GAP}*" + host_alone(host).removeprefix("(?i)")


def broken_address(scanned: Column) -> Column:
    """The lines of a text's head from its first address or host on, joined, or null; the mailbox may stand alone on the line before."""
    head = F.regexp_replace(scanned, rf"(?is)\n\s*{HEAD_END}.*", "")
    own = F.slice(F.filter(F.transform(F.split(head, "\n"), trimmed), lambda x: x != ""), 1, HEAD_LINES)

    def from_line(rows: Column, at: Column) -> Column:
        before = F.coalesce(F.get(rows, at - 2), F.lit(""))
        mailbox = ~F.contains(F.get(rows, at - 1), F.lit("@")) & before.rlike(MAILBOX) & (F.length(before) <= LONGEST_MAILBOX) & (before.rlike(r"[\d.]") | (F.length(before) >= 4))
        return F.slice(rows, F.when(mailbox, at - 1).otherwise(at), ADDRESS_LINES)

    def up_to_heading(part: Column) -> Column:
        end = first_where(part, lambda x: x.rlike(rf"(?i)^{HEAD_END}")).cast("int")
        return F.array_join(F.when(end > 0, F.slice(part, 1, end - 1)).otherwise(part), " ")

    # The first line is searched for once, as all that follows takes it as a lambda's variable.
    place = lambda rows: first_where(rows, lambda x: x.rlike(HOST_LINE)).cast("int")
    return once(own, lambda rows: once(place(rows), lambda at: F.when(at > 0, once(from_line(rows, at), up_to_heading))))


def whole_addresses(flat: Column) -> Column:
    """All persons' addresses of a text without spaces."""
    every = lambda pattern, group: F.regexp_extract_all(flat, F.lit(pattern), F.lit(group))
    found = F.transform(F.concat(every(EMAIL, 0), every(TOKEN, 1)), lambda x: F.lower(x))
    return F.filter(found, lambda a: F.length(a).between(5, LONGEST_ADDRESS) & ~a.rlike(NOBODY))


def once(value: Column, f) -> Column:
    """f of a value that is computed once, as it is a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def single_lines(c: Column) -> Column:
    """Unix lines without characters of no width; most texts have neither and stay as they are."""
    clean = lambda t: F.regexp_replace(unix_lines(t), "[​‌﻿]", "")
    return once(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike("[\r​‌﻿]"), clean(t)).otherwise(t))


def near_anchors(c: Column) -> Column:
    """The parts of a text, each with the stop ahead of it, in which an address can be: what scannable and addresses make of them is what they make of the text.

    Of other parts a line's end is left, behind a sign that no repair takes away with it.
    """
    end = lambda x: F.when(F.contains(x, F.lit("\n")), F.concat(F.substring(x, 1, 1), F.lit("\n"))).otherwise("")
    cut = lambda t: F.array_join(F.transform(F.split(t, f"(?={STOPS})"), lambda x: F.when(x.rlike(ANCHOR), x).otherwise(end(x))), "")
    return once(single_lines(c), lambda t: F.when(t.rlike(ANCHOR), cut(t)).otherwise(""))


def rejoined(t: Column) -> Column:
    """Addresses in pieces put together, round by round; a round that would find nothing is left out."""

    def step(x: Column) -> Column:
        for pattern, by in REJOINED:
            x = F.regexp_replace(x, pattern, by)
        return x

    rounds = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), y, lambda x, _: F.when(x.rlike(BROKEN), step(x)).otherwise(x))
    return once(t, lambda y: F.when(y.rlike(BROKEN), rounds(y)).otherwise(y))


def scannable(c: Column) -> Column:
    """Addresses put right that a text spells out, parts by spaces, or runs together with a public host.

    A glance ahead of each kind of repair tells whether it finds anything.
    """
    t = F.regexp_replace(single_lines(c), r"(?i)\[\s*at\s*\]|\(\s*at\s*\)", "@")
    t = F.regexp_replace(t, r"(?i)\(?\s*\[?\s*dot\s*\]?\s*\)?", ".")
    t = rejoined(F.regexp_replace(t, r"([A-Za-z0-9._%+-])\s+@\s+([A-Za-z0-9._%+-])", "$1@$2"))

    def with_at_signs(x: Column) -> Column:
        for host in SPACED_HOSTS:
            pattern = spaced_host(host)
            mailbox = lambda m: F.regexp_replace(F.regexp_replace(m, pattern, "$1"), r"\s+", "")  # noqa: B023, E731
            # Such an address reaches across no stop and no line, so only the parts with a host are searched.
            parts = lambda y: F.filter(F.split(y, f"(?=\n|{STOPS})"), lambda part: part.rlike(host_alone(host)))  # noqa: B023, E731
            hits = lambda y: F.flatten(F.transform(parts(y), lambda part: F.regexp_extract_all(part, F.lit(pattern), F.lit(0))))  # noqa: B023, E731
            joined = lambda y: F.aggregate(hits(y), y, lambda acc, m: F.replace(acc, m, F.concat(mailbox(m), F.lit(f"@{host}"))))  # noqa: B023, E731
            x = once(x, lambda y: F.when(y.rlike(host_alone(host)), joined(y)).otherwise(y))  # noqa: B023
        return x

    def parted(x: Column) -> Column:
        for host in PUBLIC_HOSTS:
            x = F.regexp_replace(x, r"(?i)(^|[^@\w.])([a-z0-9][a-z0-9._%+-]{3,40}\d)" + host.replace(".", r"\.") + r"\b", f"$1$2@{host}")
        return x

    any_host = "|".join(host_alone(host).removeprefix(f"(?i){GAP}") for host in SPACED_HOSTS)
    t = once(t, lambda x: F.when(x.rlike(rf"(?i){GAP}(?:{any_host})"), with_at_signs(x)).otherwise(x))
    return once(t, lambda x: F.when(x.rlike(r"(?i)\d(?:" + "|".join(PUBLIC_HOSTS).replace(".", r"\.") + r")\b"), parted(x)).otherwise(x))


def addresses(scanned: Column) -> Column:
    """All persons' addresses of a text put right: labelled ones first, then links, then any, then lines without their spaces."""
    joined = F.filter(F.transform(F.split(scanned, "\n"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: (F.length(x) >= 6) & F.contains(x, F.lit("@")))
    every = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    in_lines = F.flatten(F.transform(joined, lambda x: F.concat(every(x, EMAIL, 0), every(x, TOKEN, 1))))
    found = F.transform(F.concat(every(scanned, LABELLED, 1), every(scanned, MAILTO, 1), every(scanned, EMAIL, 0), every(scanned, TOKEN, 1), in_lines), lambda x: F.lower(x))
    return F.filter(found, lambda a: F.length(a).between(5, LONGEST_ADDRESS) & ~a.rlike(NOBODY))
