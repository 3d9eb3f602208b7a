"""The query on education lines as DuckDB SQL: a row for each line, and neighbours merged by runs of lines that fit together."""

from __future__ import annotations

from crestline.functions import education as ed
from crestline.functions import resume as rs
from crestline.plans import bindings as b
from crestline.plans.name_oracles import OWN_WORDS, filled
from crestline.plans.resume_oracles import NL, items, prepared, q, sub, trimmed
from crestline.plans.resume_oracles import has as has_ascii

TEXTS = f"{OWN_WORDS}, texts AS (SELECT doc_id, {filled(b.SCHOOL_TOPS, 'doc_id')} || body || {filled(b.SCHOOL_TAILS, 'doc_id // 9')} AS text FROM named)"


def has(c: str, pattern: str) -> str:
    """Whether a text matches, with Latin letters beyond ASCII as letters, where DuckDB's word ends know ASCII alone."""
    return has_ascii(sub(c, "[À-ÖØ-öø-ɏ]", "q"), pattern)


def one_line(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def stripped(c: str, chars: str = ed.EDGES) -> str:
    return sub(c, rf"^{chars}+|{chars}+$", "")


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def letters(w: str) -> str:
    return f"length(regexp_replace({w}, '[^A-Za-z]', '', 'g'))"


def until(c: str, pattern: str) -> str:
    """What stands before the first match."""
    return f"regexp_replace({c}, {q(pattern + '.*$')}, '')"


def degree(c: str) -> str:
    return "(" + " OR ".join(has(f"lower({c})", p) for p in [*rs.DEGREES.values(), ed.DEGREE_WORD]) + ")"


def noise(c: str) -> str:
    months = f"(length({c}) <= {ed.LONGEST_MONTHS} AND {has(c, ed.MONTHS_ALONE)} AND NOT {has(f'lower({c})', 'university|college|institute|degree|program')})"
    return f"(length({c}) < 2 OR {has(c, ed.NOISE)} OR {months} OR (length({c}) > {ed.LONGEST_STORY} AND {has(c, ed.FIRST_PERSON)}))"


def skills(p: str) -> str:
    t = f"lower({one_line(p)})"
    return f"({has(t, ed.SKILLS_PART)} OR ({has(t, '[●•·]')} AND NOT {has(t, ed.STUDY_WORD)} AND {has(t, ed.TOOL)}))"


def parts(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, {q(ed.BARS)}), lambda p: trim(p)), lambda p: p <> '')"


CLEAN = f"replace({sub('s', '[' + chr(0x200B) + chr(0x200C) + chr(0x200D) + chr(0xFEFF) + chr(0xAD) + ']', '')}, '｜', '|')"
BEFORE_SKILLS = f"CASE WHEN list_position(list_transform(ps, lambda p: {skills('p')}), true) > 0 THEN ps[:list_position(list_transform(ps, lambda p: {skills('p')}), true) - 1] ELSE ps END"


def without_skills(source: str, name: str) -> str:
    """CTEs that take the skills from column s of source."""
    edges = r"[ \t|—–\-/]"
    shorter = "contains(s, '|') AND len(kept) BETWEEN 1 AND len(ps) - 1 AND length(joined) < length(s)"
    technical = f"{has('s', ed.TECHNICAL)} AND length(head) >= {ed.FIRST_CUT} AND {has('s[length(head) + 1:]', ed.TECHNICAL_TAIL)}"
    bullets = " AND ".join(has("s", p) for p in [*ed.BULLET_TAIL, ed.BULLET_START])
    return f"""{name}0 AS (SELECT * REPLACE ({CLEAN} AS s) FROM {source}), {name}1 AS (SELECT *, {parts('s')} AS ps FROM {name}0),
    {name}2 AS (SELECT *, {BEFORE_SKILLS} AS kept FROM {name}1), {name}3 AS (SELECT *, {stripped("array_to_string(kept, ' | ')")} AS joined FROM {name}2),
    {name}4 AS (SELECT * EXCLUDE (ps, kept, joined) REPLACE (CASE WHEN {shorter} THEN joined ELSE s END AS s) FROM {name}3), {name}5 AS (SELECT *, {until('s', ed.TECHNICAL)} AS head FROM {name}4),
    {name} AS (SELECT * EXCLUDE head REPLACE (CASE WHEN {has('s', ed.SKILLS_TAIL)} THEN {stripped(until('s', ed.SKILLS_TAIL), edges)} WHEN {technical} THEN {stripped('head', edges)}
        WHEN {bullets} THEN {stripped(until('s', ed.BULLET_START), edges)} ELSE trim(s) END AS s) FROM {name}5)"""


def without_scraps(source: str, name: str) -> str:
    """CTEs that take the scraps behind a school's name from column s of source."""
    sizes = f"list_filter(list_transform({words('tail')}[:14], lambda w: {letters('w')}), lambda n: n > 0)"
    return f"""{name}0 AS (SELECT * REPLACE (trim(s) AS s), regexp_extract(trim(s), {q(ed.SCHOOL_NAME)}, 0) AS head, length(regexp_extract(trim(s), {q(ed.SCHOOL_NAME)}, 1)) AS start FROM {source}),
    {name}1 AS (SELECT *, trim(s[length(head) + 1:]) AS tail FROM {name}0), {name}2 AS (SELECT *, {sizes} AS sizes FROM {name}1),
    {name} AS (SELECT * EXCLUDE (head, start, tail, sizes) REPLACE (CASE WHEN length(s) >= 14 AND head <> '' AND start >= 4 AND length(tail) >= 6 AND len({words('tail')}) >= 4 AND len(sizes) >= 4
        AND list_sum(sizes) / len(sizes) < {ed.SCRAP_MEAN} THEN trim(head) ELSE s END AS s) FROM {name}2)"""


def education() -> str:
    listed = f"list_filter(list_transform(string_split({prepared('text')}, {NL}), lambda x: {trimmed('x')}), lambda x: x <> '')"
    at = f"coalesce(list_position(list_transform(l, lambda x: {has('lower(x)', rs.EDU_HEADING)}), true), 0)"
    other = f"{has('lower(x)', rs.HEADING)} AND NOT list_contains({items(ed.OWN_SECTIONS)}, regexp_extract(lower(x), {q(rs.HEADING)}, 1))"
    loose = f"""s <> '' AND NOT list_contains(list_transform(own, lambda x: lower({one_line('x')})), lower(s)) AND length(s) <= {ed.LONGEST_LOOSE_LINE} AND NOT {has('s', ed.LEAK)}
        AND ({degree('s')} OR ({has('s', ed.SCHOOL)} AND length(s) < {ed.LONGEST_SCHOOL_LINE}))"""
    bullets = f"regexp_replace(regexp_replace(s, '\\s*[•·▪▫●○]\\s+', {NL}, 'g'), ';\\s+([A-Za-z])', {NL} || '\\1', 'g')"
    cut = f"list_transform(list_filter(list_transform(string_split({bullets}, {NL}), lambda p: trim(p)), lambda p: length(p) >= {ed.SHORTEST_PIECE}), lambda p: CASE WHEN length(p) > {ed.LONGEST_ENTRY} THEN regexp_replace(p[:{ed.LONGEST_ENTRY - 1}], ' [^ ]*$', '') || '…' ELSE p END)"
    edges = r"[ |—–\-/]"
    technical = f"{has('s', ed.TECHNICAL)} AND length({until('s', ed.TECHNICAL)}) >= {ed.LAST_CUT} AND {has(f's[length({until("s", ed.TECHNICAL)}) + 1:]', ed.LAST_TAIL)}"
    before = lambda p: f"trim(regexp_extract(s, {q(p)}, 1))"
    rest = lambda p: f"trim(s[length(regexp_extract(s, {q(p)}, 1)) + 1:])"
    school = f"{has('s', ed.SCHOOL_NAME)} AND len({words(before(ed.SCHOOL_NAME))}) > 0 AND len(list_filter({words(before(ed.SCHOOL_NAME))}, lambda w: {letters('w')} > 2)) = 0"
    count = f"len({words(before(ed.COLLEGE))})"
    college = f"{has('s', ed.COLLEGE)} AND length(regexp_extract(s, {q(ed.COLLEGE)}, 1)) > 6 AND {count} > 0 AND len(list_filter({words(before(ed.COLLEGE))}, lambda w: {letters('w')} <= 3)) >= greatest(2, floor({count} * 0.55) + 0.999)"
    found = "regexp_extract_all(s, '[A-Za-z]+')"
    score = " + ".join(f"CASE WHEN {has('lower(s)', p)} THEN {v} ELSE 0 END" for v, p in ed.PART_SIGNS)
    says = f"""CASE WHEN len({found}) = 0 THEN {has('s', ed.YEAR)} ELSE ({score} - least({ed.MOST_SCRAP_COST}, len(list_filter({found}, lambda w: length(w) <= 2)) * {ed.SCRAP_COST}) - CASE WHEN length(s) > {ed.LONG_PART} THEN {ed.LONG_COST} ELSE 0 END) >= {ed.LEAST_SCORE} END"""
    return f"""WITH {TEXTS}, listed AS (SELECT doc_id, {listed} AS l FROM texts), cut_at AS (SELECT *, CASE WHEN {at} > 0 THEN l[{at} + 1:] ELSE [] END AS rest FROM listed),
    stopped AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: ({other}) OR length(x) > {rs.LONGEST_LINE}), true), 0) AS stop FROM cut_at),
    halves AS (SELECT doc_id, rest[:CASE WHEN stop > 0 THEN least(stop - 1, {rs.MOST_LINES}) ELSE {rs.MOST_LINES} END] AS own, list_filter(l, lambda x: {has('x', ed.SCHOOL_LINE)}) AS schools FROM stopped),
    body AS (SELECT doc_id, 0 AS src, unnest(range(len(own))) AS i, {one_line('unnest(own)')} AS s FROM halves
        UNION ALL SELECT doc_id, 1, i, s FROM (SELECT doc_id, own, unnest(range(len(schools))) AS i, {one_line('unnest(schools)')} AS s FROM halves) WHERE len(own) = 0 OR ({loose})),
    {without_skills('body', 'bare')},
    sound AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY min((src, i))) AS n FROM bare WHERE s <> '' AND length(s) <= {ed.LONGEST_LINE} AND NOT {noise(one_line('s'))} GROUP BY doc_id, s),
    told AS (SELECT *, {has('s', ed.SCHOOL)} AS school, {degree('s')} AS degree FROM sound),
    fits AS (SELECT *, lead(s) OVER w AS after, coalesce((school AND lead(degree) OVER w AND NOT degree) OR (lead(school) OVER w AND degree AND NOT lead(degree) OVER w), false) AS fit, (school AND lead(degree) OVER w AND NOT degree) AS first_school FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    runs AS (SELECT *, n - coalesce(max(CASE WHEN NOT fit THEN n END) OVER (PARTITION BY doc_id ORDER BY n), 0) AS place FROM fits),
    taken AS (SELECT *, fit AND place % 2 = 1 AS opens, coalesce(lag(fit AND place % 2 = 1) OVER (PARTITION BY doc_id ORDER BY n), false) AS closes FROM runs),
    merged AS (SELECT doc_id, n, CASE WHEN opens AND first_school THEN {one_line('s')} || ' — ' || {one_line('after')} WHEN opens THEN {one_line('after')} || ' — ' || {one_line('s')} ELSE s END AS s FROM taken WHERE NOT closes),
    quiet AS (SELECT doc_id, n, {one_line('s')} AS s FROM merged WHERE NOT {noise(one_line('s'))}),
    listed_pieces AS (SELECT doc_id, n, CASE WHEN length(s) < 2 THEN [] WHEN length(s) <= {ed.LONGEST_ENTRY} THEN [s] WHEN len({cut}) > 0 THEN {cut} ELSE [s[:{ed.LONGEST_ENTRY}]] END AS c FROM quiet),
    piece AS (SELECT doc_id, n, unnest(range(len(c))) AS i, unnest(c) AS s FROM listed_pieces), {without_skills('piece', 'fine')},
    entry AS (SELECT doc_id, {one_line('s')} AS s, min((n, i)) AS place FROM fine WHERE trim(s) <> '' AND NOT {noise(one_line('s'))} AND NOT ({has('s', ed.LEAK)} AND length(s) > {ed.LONGEST_LEAK}) GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min((n, i))) <= {ed.MOST_ENTRIES}),
    whole AS (SELECT doc_id, string_agg(s, ' | ' ORDER BY place) AS s FROM entry GROUP BY doc_id), {without_skills('whole', 'tailless')},
    short AS (SELECT doc_id, CASE WHEN {has('s', ed.LAST_TECHNICAL)} THEN {stripped(until('s', ed.LAST_TECHNICAL), edges)} WHEN {technical} THEN {stripped(until('s', ed.TECHNICAL), edges)} ELSE s END AS s FROM tailless),
    tidy AS (SELECT doc_id, {stripped(r"regexp_replace(s, '(\s*\|)+\s*$', '')", edges)} AS s FROM short),
    barred AS (SELECT doc_id, {parts(CLEAN)} AS ps FROM tidy WHERE contains(s, '|')), numbered AS (SELECT doc_id, {BEFORE_SKILLS} AS ps FROM barred WHERE len(ps) >= 2),
    part AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS s FROM numbered), schooled AS (SELECT doc_id, i, CASE WHEN {school} THEN {rest(ed.SCHOOL_NAME)} ELSE s END AS s FROM part),
    colleged AS (SELECT doc_id, i, CASE WHEN {college} THEN {rest(ed.COLLEGE)} ELSE s END AS s FROM schooled), {without_scraps('colleged', 'unscrapped')},
    said AS (SELECT doc_id, {stripped("string_agg(s, ' | ' ORDER BY i)")} AS said FROM unscrapped WHERE s <> '' AND {says} GROUP BY doc_id),
    last AS (SELECT doc_id, coalesce(said, s) AS s FROM tidy LEFT JOIN said USING (doc_id)), {without_scraps('last', 'ended')}
    SELECT doc_id, coalesce(s, '') AS education FROM texts LEFT JOIN ended USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"education_lines": education()}
