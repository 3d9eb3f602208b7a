"""The queries on names as DuckDB SQL: a row for each guess, where the plan keeps arrays."""

from __future__ import annotations

from crestline.functions import names as n
from crestline.plans import bindings as b
from crestline.plans.resume_oracles import NL, has, items, pick, q, sub, trimmed, unix


def filled(values: list[str], number: str) -> str:
    out = pick(values, number)
    spaced = lambda w: f"trim(regexp_replace({w}, '(.)', '\\1 ', 'g'))"
    for mark, word in {"{first}": "first", "{second}": "second", "{FIRST}": "upper(first)", "{SECOND}": "upper(second)", "{f}": spaced("first"), "{s}": spaced("second")}.items():
        out = f"replace({out}, {q(mark)}, {word})"
    return out


OWN_WORDS = """own AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,}') AS w FROM documents),
    named AS (SELECT doc_id, body, coalesce(w[1], 'Ada') AS first, coalesce(w[2], 'Byron') AS second FROM own)"""
TEXTS = f"""{OWN_WORDS}, texts AS (SELECT doc_id, {filled(b.NAME_TOPS, 'doc_id')} || body || {filled(b.NAME_TAILS, 'doc_id // 13')} AS text, lower({filled(b.NAME_MAILS, 'doc_id // 5')}) AS email,
        {filled(b.NAME_FILES, 'doc_id')} AS file_name, {filled(b.NAME_SLUGS, 'doc_id')} AS slug FROM named)"""


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def latin(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z]+')"


def job_title(c: str) -> str:
    low, roles = f"trim(lower({c}))", f"len(list_filter({latin(c)}, lambda w: list_contains({items(n.ROLES)}, w)))"
    title = f"length(regexp_extract({low}, {q(n.TITLE)}, 0))"
    return f"({has(low, n.DOMAIN_TITLE)} OR ({title} > 0 AND {title} >= least(length({low}) * 0.65, length({low}) - 2)) OR {roles} >= 2 OR ({roles} >= 1 AND len({latin(c)}) >= 4))"


def topic(c: str) -> str:
    return f"(list_contains({items(n.PHRASES)}, array_to_string({words(f'lower({c})')}, ' ')) OR len({latin(c)}) = 0 OR list_has_any({latin(c)}, {items(n.TOPICS)}))"


def person(c: str) -> str:
    short = f"len(list_filter(string_split({c}, ' '), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 4)) = 0"
    scrap = f"({has(c, r'(?:^| )\p{Ll}(?: |$)')} OR (len(string_split({c}, ' ')) >= 3 AND {has(c, r'\p{Ll}')} AND {short}))"
    return f"({c} <> '' AND NOT list_contains({items(n.NO_VALUE)}, lower({c})) AND NOT {scrap} AND NOT {has(c, n.CREDENTIAL)} AND NOT {job_title(c)} AND NOT {topic(c)})"


def normalised(source: str, name: str) -> str:
    """CTEs from the rows of source (doc_id, score, raw) to those of name (doc_id, score, name)."""
    word = f"{has('w', r'\p{L}')} AND {has('w', r"^[\p{L}'’.-]+$")} AND NOT {has('w', r'\..*\.')} AND NOT {has('w', r"^(?:(?i:jr|sr)|\p{L}['’-])$")}"
    bare = trimmed(f"regexp_replace(regexp_replace(r, '\\s*\\([^)]{{0,80}}\\)\\s*$', ''), '\\s*[•|·]+$', '')")
    tail = items([*n.PLACES, *n.ROLES, *n.TITLE_WORDS])
    capital = "CASE WHEN length(w) <= 2 AND w LIKE '%.' THEN w ELSE upper(w[1]) || lower(w[2:]) END"
    return f"""{name}0 AS (SELECT doc_id, score, regexp_replace({trimmed('raw')}, {q(n.HONORIFIC)}, '') AS r FROM {source}),
    {name}1 AS (SELECT doc_id, score, r, list_transform(string_split(r, ','), lambda h: {trimmed('h')}) AS halves FROM {name}0),
    {name}2 AS (SELECT doc_id, score, CASE WHEN len(halves) = 2 AND NOT list_contains(halves, '') THEN halves[2] || ' ' || halves[1] ELSE r END AS r FROM {name}1),
    {name}3 AS (SELECT doc_id, score, {words(bare)} AS parts FROM {name}2),
    {name}4 AS (SELECT * FROM {name}3 WHERE len(parts) BETWEEN 2 AND 6 AND len(list_filter(parts, lambda w: NOT ({word}))) = 0),
    {name}5 AS (SELECT *, array_to_string(parts[:list_max(list_transform(parts, lambda w, i: CASE WHEN list_contains({tail}, lower(w)) THEN 2 ELSE greatest(i, 2) END))], ' ') AS said FROM {name}4),
    {name} AS (SELECT doc_id, score, CASE WHEN {has('said', n.NOT_CAPITAL)} THEN said ELSE array_to_string(list_transform(string_split(said, ' '), lambda w: {capital}), ' ') END AS name FROM {name}5
        WHERE NOT {has('said', r'\p{Ll}')} OR len(list_filter(parts, lambda w: {has('w', r'^[^\p{L}.]*(?:\p{Lu}[^\p{L}.]*){2,4}$')})) = 0)"""


def before_contact(c: str) -> str:
    edge = lambda x, chars: sub(x, rf"^[{chars}]+|[{chars}]+$", "")
    group = lambda p: f"regexp_extract({c}, {q(p)}, 1)"
    left = r"\s,|•–-"
    mailbox = edge(f"regexp_replace({edge(group(rf'^(.*?){n.MAILBOX}'), left)}, {q(n.CONTACT_LABEL_END)}, '')", left)
    label, link = edge(group(rf"^(.*?){n.MAIL_LABEL}"), r"\s|·•,;–-"), edge(group(r"(?i)^(.*?)linkedin\.com/"), r"\s,|·•–-")
    phone = sub(f"CASE WHEN {has(c, n.LONG_PHONE)} THEN {group(rf'^(.*?){n.LONG_PHONE}')} ELSE {group('(?i)^(.*?)(?:' + n.PHONE.removeprefix('(?i)') + ')')} END", r"[\s,;:|·•–-]+$", "")
    found = f"list_filter([{mailbox}, {label}, {link}, {phone}], lambda x: length(x) BETWEEN 3 AND 120)[1]"
    return f"coalesce(CASE WHEN length({found}) <= 100 THEN {found} END, '')"


def names() -> str:
    reaches = lambda c: f"({has(c, n.CONTACT)} OR {has(c, n.PHONE)})"
    bars = r"'\s*\|\s*'"
    pieces = f"string_split_regex(t, {bars})"
    lost = f"length(t) - length(replace(t, {NL}, '')) < 4 AND contains(t, '|')"
    unfolded = f"CASE WHEN {lost} THEN array_to_string({pieces}[:{n.MOST_SPLITS}], {NL}) || CASE WHEN len({pieces}) > {n.MOST_SPLITS} THEN {NL} || array_to_string({pieces}[{n.MOST_SPLITS + 1}:], ' | ') ELSE '' END ELSE t END"
    letters = f"len(list_filter({words('s')}, lambda w: {has('w', r'^\p{L}$')}))"
    joined = f"CASE WHEN len({words('s')}) >= 3 AND {letters} >= greatest(3, floor(len({words('s')}) * 0.55)) THEN array_to_string({words('s')}, '') ELSE s END"
    part = f"CASE WHEN length(p) < 5 OR len(string_split_regex(p, '\\s{{2,}}')) < 2 THEN p ELSE array_to_string(list_transform(string_split_regex(p, '\\s{{2,}}'), lambda s: {joined}), ' ') END"
    mended = f"CASE WHEN i > {n.SPACED_LINES} OR length(x) < 5 THEN x ELSE array_to_string(list_transform(list_filter(string_split_regex(x, {bars}), lambda p: p <> ''), lambda p: {part}), ' | ') END"
    label = f"coalesce(nullif(regexp_extract(x, {q(n.LABEL)}, 1), ''), regexp_extract(x, {q(n.LABEL_WITHIN)}, 1))"
    plain = f"{has('x', r"^[\p{L}\s'-]{3,70}$")} AND NOT contains(x, chr(9)) AND {' AND '.join(f'NOT contains(lower(x), {q(w)})' for w in n.NO_LETTER_LINE)} AND len({words("replace(x, '-', ' ')")}) BETWEEN 2 AND 5"
    local = trimmed(f"string_split({trimmed("string_split(email, '@')[1]")}, '+')[1]")
    sent = f"list_filter(list_transform(string_split_regex({local}, '[._-]+'), lambda w: regexp_replace(w, '\\d+$', '')), lambda w: {has('w', r'^\p{L}{2,}$')})"
    return f"""WITH {TEXTS},
    laid AS (SELECT doc_id, {sub(trimmed(unix('text')), n.INVISIBLE, ' | ')} AS t FROM texts),
    flat AS (SELECT doc_id, {unfolded} AS t FROM laid),
    listed AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, {q(n.LINE_END)}), lambda x: {trimmed('x')}), lambda x: x <> '')[:{n.MOST_LINES}] AS ls FROM flat),
    numbered AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM listed),
    line AS (SELECT doc_id, i, {mended} AS x FROM numbered),
    cut AS (SELECT doc_id, i, x, list_filter(list_transform(string_split_regex(x, {q(n.PART_END)}), lambda p: {trimmed('p')}), lambda p: p <> '') AS ps FROM line WHERE i <= {n.PART_LINES} AND NOT {has('x', n.NO_NAME_LINE)}),
    part AS (SELECT doc_id, {n.PART_SCORE} - 2 * (i - 1) + CASE WHEN {reaches('x')} THEN {n.CONTACT_BONUS} ELSE 0 END AS base, unnest(ps) AS p, unnest(range(0, len(ps))) AS j FROM cut),
    guess AS (SELECT doc_id, {n.LABEL_SCORE} - (i - 1) AS score, string_split({label}, '|')[1] AS raw FROM line WHERE i <= {n.LABEL_LINES}
        UNION ALL SELECT doc_id, base + greatest(0, {n.PLACE_BONUS} - 2 * j) + CASE WHEN {reaches('p')} THEN {n.PREFIX_BONUS} ELSE 0 END, CASE WHEN {reaches('p')} THEN {before_contact('p')} ELSE p END
            FROM part WHERE length(p) <= CASE WHEN contains(p, '@') OR contains(lower(p), 'mail') THEN {n.LONGEST_CONTACT_PART} ELSE {n.LONGEST_PART} END
        UNION ALL SELECT doc_id, {n.LETTER_SCORE} - (i - 1), array_to_string({words("replace(x, '-', ' ')")}, ' ') FROM line WHERE i <= {n.LETTER_LINES} AND {plain}
        UNION ALL SELECT doc_id, {n.OWNER_SCORE}, regexp_extract(t, {q('(?im)' + n.OWNER)}, 1) FROM flat),
    {normalised('guess', 'whole')}, found AS (SELECT * FROM whole WHERE {person('name')}),
    beside AS (SELECT doc_id, {n.CONTACT_SCORE} - (i - 1) AS score, {before_contact('x')} AS raw FROM line ANTI JOIN found USING (doc_id) WHERE i <= {n.CONTACT_LINES}),
    {normalised('beside', 'left_over')}, every_guess AS (FROM found UNION ALL FROM left_over WHERE {person('name')}),
    best AS (SELECT doc_id, min((-score, name)) AS top FROM every_guess WHERE score >= {n.LEAST_SCORE} GROUP BY doc_id),
    sent AS (SELECT doc_id, array_to_string(list_transform({sent}[:{n.MOST_LOCAL_WORDS}], lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM texts
        WHERE contains(email, '@') AND length({local}) <= {n.LONGEST_LOCAL} AND NOT list_contains({items(n.OFFICES)}, {local}) AND len({sent}) >= 2),
    mailed AS (SELECT * FROM sent WHERE NOT {job_title('name')} AND NOT {topic('name')} AND NOT {has('name', n.CREDENTIAL)})
    SELECT doc_id, coalesce(top[2], name, '') AS name, CASE WHEN top IS NOT NULL THEN 'resume' WHEN name IS NOT NULL THEN 'email' ELSE 'unknown' END AS name_source FROM texts LEFT JOIN best USING (doc_id) LEFT JOIN mailed USING (doc_id)"""


def file_names() -> str:
    is_last = f"CASE WHEN list_contains({items(n.FILE_WORDS)}, regexp_replace(lower(w), '[0-9.]+$', '')) THEN 0 ELSE i END"
    is_key = f"({has('w', '^[a-zA-Z0-9]{6,20}$')} AND ({has('w', '^(?i:[a-f0-9]{6,12})$')} OR {has('w', r'[0-9]')}))"
    return f"""WITH {TEXTS},
    base AS (SELECT doc_id, regexp_replace(file_name, '^.*/', '') AS base, {trimmed("replace(url_decode(replace(slug, '+', '%20')), '+', ' ')")} AS slug FROM texts),
    stems AS (SELECT doc_id, slug, base, regexp_replace(base, '\\.[^.]+$', '') AS stem FROM base),
    cut AS (SELECT *, {words(sub('stem', '[_-]+', ' '))} AS ws, {words(sub('slug', '-', ' '))} AS ps FROM stems),
    kept AS (SELECT *, ws[:coalesce(list_max(list_transform(ws, lambda w, i: {is_last})), 0)] AS ks FROM cut),
    said AS (SELECT doc_id, 0 AS score, array_to_string(ks, ' ') AS raw FROM kept WHERE length(stem) BETWEEN 1 AND {n.LONGEST_STEM} AND NOT {has('stem', n.NO_FILE)} AND NOT {has('stem', r'^[\d\s._-]+$')} AND NOT {has('ws[1]', '^[0-9]+$')} AND len(ks) >= 2),
    sound AS (SELECT * FROM said WHERE NOT {job_title('raw')} AND NOT {topic('raw')} AND NOT {has('raw', n.CREDENTIAL)}), {normalised('sound', 'stem_name')}
    SELECT doc_id, trim(replace(stem, '_', ' ')) AS shown, coalesce(name, '') AS name,
        array_to_string(ps[:list_max(list_transform(ps, lambda w, i: CASE WHEN i > 1 AND {is_key} THEN 1 ELSE i END))], ' ') AS profile_name
    FROM kept LEFT JOIN (SELECT doc_id, name FROM stem_name WHERE NOT {job_title('name')}) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"resume_names": names(), "file_names": file_names()}
