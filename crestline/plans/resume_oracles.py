"""The queries on résumé texts and on the matching of skills and titles as DuckDB SQL."""

from __future__ import annotations

from crestline.functions import chrome as ch
from crestline.functions import matching as mt
from crestline.functions import resume as rs
from crestline.functions import text as tx
from crestline.operators import resume as ry
from crestline.operators import skill_mining as sm
from crestline.plans import bindings as b

NL = "chr(10)"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def items(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def pick(values: list[str], number: str) -> str:
    return f"({items(values)})[(({number}) % {len(values)} + 1)::INT]"


def sub(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def trimmed(c: str) -> str:
    return sub(c, r"^\s+|\s+$", "")


def unix(c: str) -> str:
    return f"replace(replace(coalesce({c}, ''), chr(13) || {NL}, {NL}), chr(13), {NL})"


def lines(c: str) -> str:
    return f"list_filter(list_transform(string_split({unix(c)}, {NL}), lambda x: {trimmed('x')}), lambda x: x <> '')"


RESUMES = f"resumes AS (SELECT p_partkey AS candidate_id, {pick(b.HEADS, 'p_partkey')} || {NL} || {pick(b.BODIES, 'p_partkey // 6')} || {pick(b.TAILS, 'p_partkey')} AS text FROM part)"


def first_most(counts: dict[str, str], default: str) -> str:
    found = "[" + ", ".join(counts.values()) + "]"
    return f"CASE WHEN list_max({found}) > 0 THEN ({items(list(counts))})[list_position({found}, list_max({found}))] ELSE {q(default)} END"


# Smart filter.
FORMS = "[p, replace(p, ' ', ''), replace(p, '-', ' '), replace(p, '-', ''), replace(p, '_', ' '), replace(p, '_', '')]"
GROUPS = "[" + ", ".join(items(g) for g in mt.ALIASES) + "]"
SPELLINGS = f"list_distinct(list_concat({FORMS}, flatten(list_filter({GROUPS}, lambda g: list_has_any(g, {FORMS})))))"
EDGES = "' .,;:|/\\' || chr(9) || chr(10) || chr(13)"


def phrases(c: str) -> str:
    clean = f"trim(lower(trim(trim(regexp_replace(regexp_replace(x, {q(mt.BULLETS)}, ''), '\\s+', ' ', 'g')), {EDGES})))"
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), {q(mt.PHRASE_ENDS)}), lambda x: {clean}), lambda x: x <> '' AND NOT list_contains({items(mt.NO_SKILL)}, x))"


def said(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), {q(mt.KEYWORD)}), lambda x: NOT list_contains({items(mt.GENERIC_TITLE_WORDS)}, x))"


BAG = f"list_concat(flatten(list_transform(h0, lambda p: {SPELLINGS})), list_filter(flatten(list_transform(h0, lambda p: regexp_extract_all(p, {q(mt.KEYWORD)}))), lambda w: length(w) >= 2 AND NOT list_contains({items(mt.SKILL_STOPS)}, w)))"


def smart(bucket: str, matches: str) -> str:
    return f"""near AS (SELECT job_id, candidate_id, j.skills AS s1, c.skills AS s2, j.title AS jt, c.title AS ct, c.role_label AS rl FROM rankings r JOIN jobs j USING (job_id) JOIN candidates c USING (candidate_id) WHERE similarity >= 0.05),
    lists AS (SELECT DISTINCT s1, s2, {phrases('s1')} AS w0, {phrases('s2')} AS h0 FROM near), bags AS (SELECT s1, s2, list_transform(w0, lambda p: {SPELLINGS}) AS w, {BAG} AS h FROM lists),
    compared AS (SELECT s1, s2, len(w) > 0 AS asks, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda v: list_has_any(v, h)))::DOUBLE / len(w) END AS overlap FROM bags),
    t AS (SELECT *, {bucket} AS bucket, lower(ct || ' ' || rl) AS hay, {said('jt')} AS k1, list_concat({said('ct')}, {said('rl')}) AS k2 FROM near JOIN compared USING (s1, s2))
    SELECT job_id, candidate_id, round_even(overlap, 4) AS overlap FROM t WHERE (NOT asks OR overlap >= 0.2) AND {matches} AND (bucket = 'other' OR (asks AND overlap >= 0.3) OR len(k1) = 0 OR len(k2) = 0 OR list_has_any(k1, k2))"""


DEPARTMENT = first_most({d: " + ".join(f"contains(blob, {q(w)})::INT" for w in words) for d, words in mt.DEPARTMENT_WORDS.items()}, "general")
TITLE = "trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9+#.\\s/-]', ' ', 'g'), '\\s+', ' ', 'g'))"
CLEAN_TITLE = f"""SELECT candidate_id, CASE WHEN length(t) <= 60 AND len(string_split(t, ' ')) <= 8 AND NOT {has('t', mt.SENTENCE)} AND list_has_any(k, {items(mt.ROLE_WORDS)}) THEN array_to_string(k[1:5], ' ') ELSE 'unknown' END AS title
    FROM (SELECT *, list_filter(string_split(t, ' '), lambda w: w <> '' AND NOT list_contains({items(mt.FIRM_WORDS)}, w)) AS k FROM (SELECT candidate_id, {TITLE.replace('title', 'raw')} AS t FROM raws))"""
CORE = lambda c, parts: "(" + " OR ".join(f"contains({c}, {q(p)})" for p in parts) + ")"

# Sections.
OTHER = f"({has('lower(x)', rs.HEADING)} AND NOT list_contains(['certifications', 'certification'], regexp_extract(lower(x), {q(rs.HEADING)}, 1)))"
AT = f"coalesce(list_position(list_transform(l, lambda x: {has('lower(x)', rs.CERT_HEADING)}), true), 0)"
CERTS = f"""named AS (SELECT candidate_id, list_filter(l, lambda x: {has('lower(x)', rs.CERT_WORD)} OR {has('lower(x)', rs.CERT_VENDOR)} OR (length(x) BETWEEN 2 AND 160 AND {has('lower(x)', rs.CERT_NAME)} AND NOT ({has('lower(x)', rs.CERT_LEAK)} AND length(x) > 50)
        AND NOT ({has('lower(x)', rs.CERT_JOB)} AND length(x) > 55) AND ({has('lower(x)', rs.CERT_SAID)} OR length(x) <= 52))) AS named, CASE WHEN {AT} > 0 THEN l[{AT} + 1:] ELSE [] END AS rest FROM items),
    cut AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: {OTHER} OR length(x) > 500), true), 0) AS stop FROM named),
    every_ AS (SELECT candidate_id, list_concat(rest[1:CASE WHEN stop > 0 THEN least(stop - 1, 24) ELSE 24 END], named) AS c FROM cut), ordered AS (SELECT candidate_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM every_),
    firsts AS (SELECT candidate_id, regexp_replace(x, '\\s+', ' ', 'g') AS x, min(i) AS i FROM ordered WHERE length(x) <= 400 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY min(i)) <= 14), certs AS (SELECT candidate_id, string_agg(x, ' | ' ORDER BY i) AS certifications FROM firsts GROUP BY 1)"""
DEGREE = "CASE " + " ".join(f"WHEN {has('lower(text)', p)} THEN {q(n)}" for n, p in rs.DEGREES.items()) + " ELSE '' END"

# Chunks.
CHUNKS = f"list_filter(list_transform(string_split_regex(regexp_replace(text, '\\n(\\s{{0,3}}[A-Z][a-z]+ \\d{{4}})', {NL} || {NL} || '\\1', 'g'), '\\n{{2,}}'), lambda x: {trimmed('x')}), lambda x: length(x) > 15)"
SCORES = {role: ["0.01" if role == "other" else f"CASE WHEN length(c) <= 100 AND NOT contains(c, {NL}) THEN 2.5 ELSE 0.0 END" if role == "header" else "0.0"] for role in rs.CHUNK_ROLES}
for _role, _weight, _patterns in rs.CHUNK_SIGNS:
    SCORES[_role].append(f"CASE WHEN {' AND '.join(has('lower(c)', p) for p in _patterns)} THEN {_weight} ELSE 0.0 END")
RIVALS = " ".join(f"WHEN s[{rs.CHUNK_ROLES.index(r) + 1}] > s[2] + 0.5 THEN {q(r)}" for r in ("experience", "skills", "education", "certifications"))
CHUNK_ROLES = f"""chunks AS (SELECT candidate_id, CASE WHEN len({CHUNKS}) > 0 THEN {CHUNKS} WHEN length({trimmed('text')}) > 15 THEN [{trimmed('text')}] ELSE [] END AS cs FROM resumes), each AS (SELECT candidate_id, unnest(cs) AS c, generate_subscripts(cs, 1)::INT AS place FROM chunks),
    scored AS (SELECT *, [{', '.join(f"({' + '.join(x)})::DOUBLE" for x in SCORES.values())}] AS s FROM each), best AS (SELECT *, ({items(rs.CHUNK_ROLES)})[list_position(s, list_max(s))] AS best FROM scored)
    SELECT candidate_id, place, CASE WHEN length(c) < 12 OR list_max(s) < 1.2 THEN 'other' WHEN best <> 'about' THEN best {RIVALS} ELSE 'about' END AS role FROM best"""

# Lines without personal data.
KEEP = f"array_to_string(list_transform(string_split({sub(sub(sub(unix('text'), tx.EMAIL, ' [EMAIL] '), tx.PHONE, ' [PHONE] '), tx.URL, ' [URL] ')}, {NL}), lambda x: {trimmed(sub('x', '[ ' + chr(9) + ']+', ' '))}), {NL})"


# Addresses.
def scannable(c: str) -> str:
    c = sub(unix(c), "[​‌﻿]", "")
    c = sub(sub(c, r"(?i)\[\s*at\s*\]|\(\s*at\s*\)", "@"), r"(?i)\(?\s*\[?\s*dot\s*\]?\s*\)?", ".")
    c = sub(c, r"([A-Za-z0-9._%+-])\s+@\s+([A-Za-z0-9._%+-])", r"\1@\2")
    for _ in range(rs.ROUNDS):
        for pattern, by in ((r"([\w.%+-])\s+([\w.%+-])\s*@", r"\1\2@"), (r"@\s*([\w.-])\s+([\w.-])", r"@\1\2"), (r"([\w.%+-])\s+\.\s+([\w.%+-])", r"\1.\2"), (r"(?i)(\.[a-z]{2,})\s+\.", r"\1.")):
            c = sub(c, pattern, by)
    for host in rs.SPACED_HOSTS:
        p = rs.spaced_host(host)
        c = f"list_transform([{c}], lambda t: list_reduce(regexp_extract_all(t, {q(p)}), lambda acc, m: replace(acc, m, {sub(f'regexp_replace(m, {q(p)}, {q(chr(92) + '1')})', chr(92) + 's+', '')} || {q('@' + host)}), t))[1]"
    for host in rs.PUBLIC_HOSTS:
        c = sub(c, r"(?i)(^|[^@\w.])([a-z0-9][a-z0-9._%+-]{3,40}\d)" + host.replace(".", r"\.") + r"\b", rf"\1\2@{host}")
    return c


_all = lambda c, p, g: f"regexp_extract_all({c}, {q(p)}, {g})"
IN_LINES = f"flatten(list_transform(list_filter(list_transform(string_split(t, {NL}), lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: length(x) >= 6 AND contains(x, '@')), lambda x: list_concat({_all('x', tx.EMAIL, 0)}, {_all('x', rs.TOKEN, 1)})))"
EMAILS = f"list_filter(list_transform(list_concat({_all('t', rs.LABELLED, 1)}, {_all('t', rs.MAILTO, 1)}, {_all('t', tx.EMAIL, 0)}, {_all('t', rs.TOKEN, 1)}, {IN_LINES}), lambda a: lower(a)), lambda a: length(a) BETWEEN 5 AND 320 AND NOT {has('a', rs.NOBODY)})"


# Years of experience.
def prepared(c: str) -> str:
    c = unix(c)
    for wrong, right in tx.MENDED.items():
        c = f"replace({c}, {q(wrong)}, {q(right)})"
    c = sub(sub(c, "[   ]", " "), r"(^|[^\d])(\d)\s+(\d)\s+(\d)\s+(\d)($|[^\d])", r"\1\2\3\4\5\6")
    for phrase in ry.WORK_BREAKS:
        c = sub(c, rf"(?i)\s+({phrase})\b", "\n\\1")
    c = sub(sub(c, r"\s+(EXPERIENCE)\b", "\n\\1"), r"\s+(Experience\s+[A-Z])", "\n\\1")
    for phrase in ry.STUDY_BREAKS:
        c = sub(c, rf"(?i)\s+({phrase})\b", "\n\\1")
    return c


def found(p: str) -> str:
    hits, gaps = f"regexp_extract_all(t, {q(p)})", f"string_split_regex(t, {q(p)})"
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda z: length(z))), 0)"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'hit': ({hits})[i], 'at': ({size(f'({gaps})[1:i]')} + {size(f'({hits})[1:i - 1]')})::BIGINT}})"


def around(before: int, after: int) -> str:
    return f"substr(t, greatest(x.at - {before}, 0) + 1, x.at + length(x.hit) + {after} - greatest(x.at - {before}, 0))"


def behind(n: int) -> str:
    return f"substr(t, x.at + length(x.hit) + 1, {n})"


def guarded(p: str, loose: bool) -> str:
    tenure = f" AND ({has(behind(64), ry.TENURE_AFTER)} OR {has('substr(t, greatest(x.at - 56, 0) + 1, x.at - greatest(x.at - 56, 0))', ry.TENURE_BEFORE)})" if loose else ""
    keep = f"NOT ({has(around(70, 35), ry.STUDY)} AND NOT {has(around(70, 35), ry.WORK)} AND NOT contains({behind(28)}, 'experience')) AND NOT {has(behind(64), ry.NO_TENURE)}{tenure}"
    return f"list_transform(list_filter({found(p)}, lambda x: {keep}), lambda x: regexp_extract(x.hit, {q(p)}, 1)::DOUBLE)"


def sound(spans: list[str], year: int) -> str:
    return f"list_filter(list_concat({', '.join(spans)}), lambda z: z.s >= 23760 AND z.e >= 23760 AND z.s < {(year + 1) * 12} AND z.e < {(year + 1) * 12} AND z.e >= z.s)"


def year_span(hit: str, p: str, year: int) -> str:
    to = f"regexp_extract({hit}, {q(p)}, 2)"
    return f"{{'s': regexp_extract({hit}, {q(p)}, 1)::BIGINT * 12, 'e': coalesce(try_cast({to} AS BIGINT), {year}) * 12}}"


def spans(c: str, year: int) -> str:
    month = lambda m: f"(greatest(1, least(12, coalesce(try_cast({m} AS BIGINT), list_position({items(ry.MONTHS)}, substr({m}, 1, 3))))) - 1)"
    out = [f"list_transform(regexp_extract_all({c}, {q(p)}), lambda y: {year_span('y', p, year)})" for p in ry.YEAR_SPANS]
    for p, groups in ry.MONTH_SPANS:
        sm, sy, em, ey, now = (f"regexp_extract(y, {q(p)}, {g})" for g in groups)
        out.append(f"list_transform(regexp_extract_all({c}, {q(p)}), lambda y: {{'s': {sy}::BIGINT * 12 + {month(sm)}, 'e': CASE WHEN {now} <> '' THEN {year * 12 + 11} ELSE try_cast({ey} AS BIGINT) * 12 + {month(em)} END}})")
    return sound(out, year)


def covered(c: str) -> str:
    return f"least(40.0, len(list_distinct(flatten(list_transform({c}, lambda z: range(z.s, z.e))))) / 12.0)"


def blocks(heading: str, own: str) -> str:
    ends = f"{has('lower(x)', rs.HEADING)} AND NOT {has('lower(x)', ry.LABEL)}" + (f" AND NOT starts_with(regexp_extract(lower(x), {q(rs.HEADING)}, 1), {q(own)})" if own else "")
    marked = f"CASE WHEN {has('lower(x)', heading)} THEN chr(1) || 'W' || {trimmed(f'regexp_replace(lower(x), {q(heading)}, {q('')})')} WHEN {ends} THEN chr(1) || 'E' ELSE lower(x) END"
    return f"string_split(array_to_string(list_transform(l, lambda x: {marked}), {NL}), chr(1))[2:]"


def years(year: int) -> str:
    text_of = lambda c: f"array_to_string(list_transform({c}, lambda x: substr(x, 2)), {NL})"
    stated = [f"list_transform(regexp_extract_all(t, {q(p)}, 1), lambda y: y::DOUBLE)" for p in ry.STATED]
    any_span = "(" + " OR ".join(has("lower(x)", p) for p in ry.ANY_SPANS) + ")"
    near = [f"list_transform(list_filter({found(p)}, lambda x: {has(around(140, 140), ry.WORK)}), lambda x: {year_span('x.hit', p, year)})" for p in ry.ANY_SPANS]
    return f"""prepared AS (SELECT candidate_id, {prepared(trimmed('text'))} AS p FROM resumes), body AS (SELECT candidate_id, lower(p) AS t, {lines('p')} AS l FROM prepared),
    cut AS (SELECT candidate_id, t, list_filter(list_concat({', '.join([*stated, guarded(ry.LED, False), guarded(ry.LOOSE, True)])}), lambda y: y > 0 AND y <= 40) AS stated, list_filter({blocks(ry.WORK_HEADING, '')}, lambda x: starts_with(x, 'W')) AS w, {blocks(ry.PROJECT_HEADING, 'project')} AS pr,
        lower(array_to_string(list_filter(l, lambda x: length(x) >= 8 AND {has('lower(x)', ry.WORK)} AND {any_span}), {NL})) AS lined FROM body),
    a AS (SELECT *, coalesce(list_position(list_transform(pr, lambda x: starts_with(x, 'W')), true), 0) AS i FROM cut), b AS (SELECT *, CASE WHEN i > 0 THEN pr[i:] ELSE [] END AS af FROM a), c AS (SELECT *, coalesce(list_position(list_transform(af, lambda x: starts_with(x, 'E')), true), 0) AS j FROM b),
    d AS (SELECT candidate_id, t, stated, CASE WHEN len(w) > 0 THEN {text_of('w')} ELSE lined END AS wt, {text_of('CASE WHEN j > 0 THEN af[1:j - 1] ELSE af END')} AS pt FROM c),
    e AS (SELECT candidate_id, stated, {spans('wt', year)} AS ws, {sound(near, year)} AS an, {spans('pt', year)} AS ps FROM d)
    SELECT candidate_id AS id, round_even(coalesce(list_max(stated), nullif({covered('ws')}, 0.0), nullif({covered('an')}, 0.0), least(5.0, {covered('ps')})), 1) AS years, len(stated) > 0 AS spelled_out FROM e"""


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def page_chrome(texts: str) -> str:
    """Line by line with row numbers; texts is SQL for id and text."""
    low = lambda c: f"lower(translate({c}, {q(ch.QUOTES)}, {q(ch.PLAIN_QUOTES)}))"
    own = has("alone", ch.SECTION)
    dropped = f"""(menu IN {tuple(ch.MENU)} OR {has('low', ch.ON_SITE)} OR (contains(low, 'on-site') AND length(raw) <= {ch.SHORT_LINE}) OR {any_of('low', ch.FOOTER)} OR ({any_of('low', ch.ADVERT)} AND NOT {own}) OR contains(low, 'clients include')
        OR (pasted AND (contains(low, 'boom!') OR {has('raw', ch.ADVERTISER)} OR chip IN {tuple(ch.CHIPS)} OR bare IN {tuple(ch.CHIPS)} OR plain IN {tuple(ch.CHIPS)} OR (NOT {own} AND ({has('alone', ch.PERSON)} OR {has('alone', ch.BRAND)})))))"""
    signs = " + ".join(f"contains({low('text')}, {q(w)})::INT" for w in ch.PASTED_PAIR)
    bare, plain = sub("chip", r"\s*\(software\)\s*$", ""), sub("bare", r"\s*\(ued\)\s*$", "")
    menu, chip = sub(trimmed("low"), r"[\s\.!?]+$", ""), sub(sub(trimmed("low"), r"\s+", " "), r"[.!?]+$", "")
    return f"""WITH t AS ({texts}),
        k AS (SELECT DISTINCT text, {any_of(low('text'), ch.PASTED)} OR {signs} >= 2 AS pasted, string_split({sub(unix('text'), chr(92) + 'n' + chr(92) + 'z', '')}, {NL}) AS ls FROM t),
        l AS (SELECT text, pasted, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM k), r AS (SELECT *, {sub('line', r'\s+$', '')} AS raw FROM l), w AS (SELECT *, {low('raw')} AS low, {trimmed('raw')} AS alone FROM r),
        c AS (SELECT *, {menu} AS menu, {chip} AS chip FROM w), d AS (SELECT *, {bare} AS bare FROM c), e AS (SELECT *, {plain} AS plain FROM d), f AS (SELECT text, string_agg(raw, {NL} ORDER BY place) AS clean FROM e WHERE alone = '' OR NOT {dropped} GROUP BY text)
        SELECT id, coalesce(clean, '') AS clean FROM t LEFT JOIN f USING (text)"""


def skill_texts() -> str:
    at = "(doc_id * 7919 % (length(text) + 1))::INT"
    return f"SELECT doc_id AS id, substring(text, 1, {at}) || {NL} || {pick(b.SKILL_PARTS, 'doc_id')} || {NL} || substring(text, {at} + 1) AS text FROM documents"


def mined() -> str:
    """Skills found by line, place and number, and a lexicon of pairs of words."""
    texts = skill_texts()
    one = sub(trimmed(sub(f"lower({trimmed('x')})", "(?i)" + sm.URL, " ")), r"\s+", " ")
    edges = "' ' || chr(9) || chr(10) || chr(13) || " + q(sm.ENTRY_EDGES.replace(" ", "").replace("\t", "").replace("\n", "").replace("\r", ""))
    table = lambda d: "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"
    plain = f"translate(y, {q(ch.QUOTES)}, {q(ch.PLAIN_QUOTES)})"
    # Word by word: none of the entry, none with a bad part.
    skill = f"y <> '' AND y NOT IN {tuple([*sm.STOP, *sm.COMMON, *sm.BRANDS])} AND y[1] <> '-' AND y[-1] <> '-' AND NOT {has('y', sm.DOMAIN_NAME)} AND NOT regexp_full_match(y, {q(sm.MISREAD)}) AND NOT {any_of(plain, [*sm.SELF_PRAISE, *ch.ADVERT])}"
    heavy = "(?i)" + r"\b(" + "|".join(w.replace("+", r"\+") for w in sm.HEAVY) + r")\b"
    word = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
    return f"""{page_chrome(texts).replace("SELECT id, coalesce(clean, '') AS clean FROM t LEFT JOIN f USING (text)", "")}, doc AS (SELECT id, coalesce(clean, '') AS clean FROM t LEFT JOIN f USING (text)),
        bw AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark), pairs AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS form FROM bw),
        phrases AS (SELECT form FROM pairs WHERE regexp_full_match(form, '([a-z][a-z])+ [a-z]([a-z][a-z])*')), tools AS (SELECT DISTINCT CASE WHEN length(form) % 5 = 0 THEN replace(form, ' ', '_') ELSE form END AS tool FROM phrases WHERE length(form) % 3 <> 0 UNION SELECT unnest({items(b.SKILL_TOOLS)})),
        spelled AS (SELECT form, replace(form, ' ', '_') AS value FROM phrases WHERE length(form) % 5 = 0 UNION ALL SELECT unnest({items(list(b.SKILL_SPELLINGS))}), unnest({items(list(b.SKILL_SPELLINGS.values()))})),
        rows_ AS (SELECT id, unnest(string_split(clean, {NL})) AS raw_, generate_subscripts(string_split(clean, {NL}), 1) AS no FROM doc), stripped AS (SELECT id, no, {trimmed('raw_')} AS line FROM rows_),
        listed AS (SELECT id, no, string_split_regex(replace(replace(regexp_extract(line, {q(ch.SECTION)}, 2), '(', ', '), ')', ' '), {q(sm.LIST_SPLIT)}) AS xs FROM stripped WHERE {has('line', ch.SECTION)}),
        full_ AS (SELECT id, no, regexp_extract_all(line, {q(sm.HEAVY_TOKEN)}) AS xs FROM stripped WHERE length(line) >= {sm.HEAVY_CHARS} AND {has('line', heavy)}),
        low AS (SELECT id, {sub(f"lower(translate(clean, {q(ch.QUOTES)}, {q(ch.PLAIN_QUOTES)}))", "(?i)" + sm.URL, " ")} AS t FROM doc), ws AS (SELECT id, regexp_extract_all(t, {q(word)}) AS w, regexp_extract_all(t, {q(sm.TECH)}) AS tech FROM low),
        said AS (SELECT id, 1 AS src, no, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM listed UNION ALL SELECT id, 2, no, unnest(xs), generate_subscripts(xs, 1) FROM full_
            UNION ALL SELECT id, 3, 0, p, i FROM (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2])) AS p, unnest(range(1, len(w) - 1)) AS i FROM ws) SEMI JOIN phrases ON p = form
            UNION ALL SELECT id, 4, 0, unnest(tech), generate_subscripts(tech, 1) FROM ws),
        cut AS (SELECT id, src, no, i, trim({one}, {edges}) AS z FROM said), own AS (SELECT * EXCLUDE z, coalesce(({table(sm.SPELLINGS)})[z], z) AS z FROM cut),
        entries AS (SELECT id, src, no, i, trim(coalesce(s.value, z)) AS y FROM own LEFT JOIN spelled s ON s.form = z),
        good AS (SELECT e.*, tool IS NOT NULL AS tool FROM entries e LEFT JOIN tools ON tool = y WHERE {skill}),
        known AS (SELECT *, count(*) FILTER (src = 2 AND (tool OR regexp_matches(y, '[.+#]'))) OVER (PARTITION BY id, no) AS n FROM good),
        kept AS (SELECT id, y, min((src, no, i)) AS place FROM known WHERE CASE src WHEN 1 THEN length(y) > 2 OR y IN {tuple(sm.SHORT_IN_LISTS)} WHEN 2 THEN n >= {sm.HEAVY_LEAST} AND (tool OR regexp_matches(y, '[.+#]')) ELSE tool OR contains(y, '.') END GROUP BY id, y),
        found AS (SELECT id, string_agg(y, '|' ORDER BY place) AS skills FROM kept GROUP BY id), domains AS (SELECT id, array_to_string(list_sort(list(DISTINCT 'domain ' || length(y) % 4)), '|') AS domains FROM kept SEMI JOIN tools ON tool = y GROUP BY id)
        SELECT id AS doc_id, coalesce(skills, '') AS skills, coalesce(domains, '') AS domains FROM doc LEFT JOIN found USING (id) LEFT JOIN domains USING (id)"""


def oracle_sql(views: dict[str, str], bucket, matches) -> dict[str, str]:
    """views are the relations' SQL by name, bucket and matches the SQL of a title's role bucket and of who matches it."""
    with_ = lambda names, body: "WITH " + ", ".join([f"{n} AS ({views[n]})" for n in names.split()]) + body
    own = f"WITH {RESUMES}"
    labels = lambda table, default: f"coalesce((MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in table.items())}}})[lower(trim(title))], {q(default)})"
    return {
        "smart_filter_pairs": with_("rankings jobs candidates", ", " + smart(bucket("lower(jt)"), matches("bucket", "hay"))),
        "low_match_warnings": with_("rankings", " SELECT job_id, count(*) FILTER (coalesce(score, similarity, 0) < 0.4) AS low FROM rankings GROUP BY 1 HAVING low > 0"),
        "role_labels": with_("candidates", f" SELECT candidate_id, {labels(mt.ROLE_LABELS, 'other')} AS label, {labels(mt.ENGINEERING_LABELS, 'fullstack')} AS engineering_label FROM candidates"),
        "job_department": with_("jobs", f" SELECT job_id, {DEPARTMENT} AS department FROM (SELECT job_id, lower(title || ' ' || description) AS blob FROM jobs)"),
        "core_skills": f"WITH t AS ({skill_texts()}), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM t) SELECT word, count(*) AS doc_freq FROM w WHERE NOT {CORE('word', mt.NOT_CORE)} AND {CORE('word', ['.', '+', '#', *mt.CORE])} GROUP BY word",
        "clean_titles": with_("candidates", f", raws AS (SELECT candidate_id, title || CASE candidate_id % 4 WHEN 0 THEN ' @ Acme Solutions Ltd' WHEN 1 THEN '' WHEN 2 THEN ', seeking work' ELSE ' – II' END AS raw FROM candidates) {CLEAN_TITLE}"),
        "profile_fallback": with_("candidates", " SELECT candidate_id, CASE WHEN years < 1 THEN '<1' WHEN years < 3 THEN '1-3' WHEN years < 5 THEN '3-5' ELSE '5+' END AS bucket, least(100, floor(least(20, greatest(0, years)) * 4 + least(30, len(list_filter(string_split(skills, ','), lambda x: trim(x) <> ''))) * 1.6 + CASE WHEN trim(degree) <> '' THEN 6 ELSE 0 END + CASE WHEN trim(certifications) <> '' THEN 4 ELSE 0 END + 0.5))::INT AS score FROM candidates"),
        "resume_certifications": f"{own}, items AS (SELECT candidate_id, {lines('text')} AS l FROM resumes), {CERTS} SELECT candidate_id, {DEGREE} AS degree, coalesce(certifications, '') AS certifications FROM resumes LEFT JOIN certs USING (candidate_id)",
        "page_chrome_filter": page_chrome(f"SELECT p_partkey AS id, {pick(b.PASTED_TOPS, 'p_partkey')} || {NL} || {pick(b.PASTED_MIDDLES, 'p_partkey // 7')} || {NL} || {pick(b.PASTED_ENDS, 'p_partkey // 3')} AS text FROM part"),
        "mined_skills": mined(),
        "chunk_roles": f"{own}, {CHUNK_ROLES}",
        "pii_keep_lines": f"{own} SELECT candidate_id, {trimmed(KEEP)} AS clean FROM resumes",
        "email_extract": f"{own}, s AS (SELECT candidate_id, {scannable('text')} AS t FROM resumes) SELECT candidate_id AS id, coalesce(({EMAILS})[1], '') AS email FROM s",
        "years_experience": f"{own}, {years(b.NOW.year + 20)}",
    }
