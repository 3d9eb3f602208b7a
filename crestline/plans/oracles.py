"""The catalogue's queries as DuckDB SQL over the fixture tables."""

from __future__ import annotations

from crestline.functions import dates as dt
from crestline.functions import skills as sk
from crestline.functions import text as tx
from crestline.operators import lexical
from crestline.operators import ranking as rk
from crestline.plans import bindings as b
from crestline.plans import address_oracles, education_oracles, inbox_oracles, name_oracles, resume_oracles
from crestline.streaming import ingestion

NOW = f"TIMESTAMP '{b.NOW.isoformat(' ')}'"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _pick(values: list[str], number: str) -> str:
    return f"({_list(values)})[(({number}) % {len(values)} + 1)::INT]"


VIEWS = {
    "clients": "SELECT c_custkey AS client_id, c_nationkey AS workspace_id, c_name AS name, c_mktsegment AS company_name FROM customer",
    "jobs": f"""SELECT o_orderkey AS job_id, o_custkey AS client_id, c_nationkey AS workspace_id, {_pick(b.TITLES, 'o_orderkey')} AS title, {_pick(b.JOB_SKILLS, 'o_orderkey')} AS skills,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'on_hold' END AS status,
        CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' WHEN o_orderpriority[1] = '5' THEN 'low' ELSE '' END AS urgency,
        (o_orderkey % 11)::DOUBLE AS min_experience, {_pick(b.REQUIRED, 'o_orderkey')} AS education_required, o_orderdate AS created_at, {_pick(b.DESCRIPTIONS, 'o_orderkey')} AS description FROM orders JOIN customer ON o_custkey = c_custkey""",
    "candidates": f"""SELECT p_partkey AS candidate_id, p_name AS full_name, {_pick(b.TITLES, 'p_partkey + p_partkey // 6')} AS title, lower(p_type) AS role_label, {_pick(b.CANDIDATE_SKILLS, 'p_partkey')} AS skills,
        p_size::DOUBLE AS years, {_pick(b.DEGREES, 'p_partkey')} AS degree, CASE WHEN p_partkey % 3 = 0 THEN 'aws certified' ELSE '' END AS certifications, {_pick(b.STATUSES, 'p_partkey')} AS status,
        CASE WHEN p_size > 25 THEN (p_partkey % 25)::INT END AS workspace_id, {NOW} - to_days((p_partkey % 400)::INT) AS created_at FROM part""",
    "applicants": f"SELECT l_orderkey AS job_id, l_partkey AS candidate_id, {_pick(b.STATUSES, 'l_partkey + l_linenumber')} AS status, l_shipdate AS updated_at FROM lineitem WHERE l_partkey % 10 <> 0",
    "rankings": "SELECT l_orderkey AS job_id, l_partkey AS candidate_id, max(l_discount) * 10 AS score, max(l_tax) * 10 AS similarity, max(l_shipdate) AS run_at FROM lineitem WHERE l_discount > 0 GROUP BY ALL",
    "hidden": "SELECT DISTINCT s_nationkey AS workspace_id, l_partkey AS candidate_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 17 = 0",
    "activity": "SELECT event_id, event_type AS kind, ts AS created_at, user_id, (user_id % 25)::INT AS workspace_id, value FROM events",
}


def _with(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")


ALIASED = "CASE lower(trim(coalesce(status,'new'))) WHEN 'interview' THEN 'interviewing' WHEN 'interviewed' THEN 'interviewing' WHEN 'declined' THEN 'rejected' WHEN 'reviewed' THEN 'screened' ELSE lower(trim(coalesce(status,'new'))) END"
EFFECTIVE = f"CASE WHEN lower(trim(coalesce(status,'new'))) = 'new' AND created_at <= {NOW} - INTERVAL 7 DAY THEN 'screened' ELSE {ALIASED} END"
COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (e IN ({names})) AS {k}" for k, names in {"new": "'new'", "screened": "'screened'", "shortlisted": "'shortlisted','selected'", "interviewing": "'interviewing'", "hired": "'hired'", "rejected": "'rejected'"}.items())
PRIORITY = "CASE lower(trim(status)) WHEN 'hired' THEN 7 WHEN 'rejected' THEN 6 WHEN 'declined' THEN 6 WHEN 'interviewing' THEN 5 WHEN 'shortlisted' THEN 4 WHEN 'selected' THEN 4 WHEN 'screened' THEN 3 WHEN 'new' THEN 1 ELSE 0 END"
ORPHANS = "candidates WHERE NOT EXISTS (SELECT 1 FROM applicants a WHERE a.candidate_id = candidates.candidate_id)"
ADVANCED = "('shortlisted','interviewing','selected','hired')"
R4 = "round_even({0}, 4)".format

# Skills: tokens, their expansion, overlap.
MAP = "MAP {" + ", ".join(f"{_q(k)}: {_list(v)}" for k, v in sk.closure().items()) + "}"
TOKENS = "list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(coalesce({0}, ''), '[()/\\\\]', ',', 'g'), '[,|\\n;]'), lambda x: trim(regexp_replace(trim(lower(x)), '\\s+', ' ', 'g'), ' .:;!?''\"`~[]{{}}<>|')), lambda x: x <> ''))".format
EXPAND = ("list_distinct(flatten(list_transform({0}, lambda t: list_concat([t, replace(t, '.', ''), CASE WHEN t = 'postgresql' THEN 'postgres' ELSE t END], coalesce((" + MAP.replace("{", "{{").replace("}", "}}") + ")[t], [t])))))").format
HAS = f"(list_has_any({EXPAND('[w]')}, ce) OR len(list_filter(ce, lambda h: length(h) >= 4 AND length(w) >= 4 AND (contains(h, w) OR contains(w, h)))) > 0)"
DEGREE = "CASE lower(trim({0})) WHEN 'intermediate' THEN 1 WHEN 'bachelors' THEN 2 WHEN 'masters' THEN 3 WHEN 'phd' THEN 4 END".format
WEIGHT = f"list_sum(list_transform({{0}}, lambda t: CASE WHEN list_contains({_list(sk.GENERIC)}, t) THEN 0.25 ELSE 1.0 END))".format
CRITICAL = f"list_filter(js, lambda w: NOT list_contains({_list(sk.GENERIC)}, w))"
CLAMP = "least(1.0, greatest(0.0, {0}))".format


def _scored(pairs: str) -> str:
    return f"""pairs AS (SELECT DISTINCT job_id, candidate_id FROM {pairs}), js AS (SELECT *, {TOKENS('skills')} AS js FROM jobs), c1 AS (SELECT *, {TOKENS('skills')} AS cs FROM candidates), c2 AS (SELECT *, {EXPAND('cs')} AS ce FROM c1),
    combos AS (SELECT DISTINCT js.skills AS s1, c2.skills AS s2, js, cs, ce FROM (SELECT DISTINCT skills, js FROM js) js, (SELECT DISTINCT skills, cs, ce FROM c2) c2),
    measured AS (SELECT s1, s2, CASE WHEN len(js) = 0 THEN 0.0 ELSE len(list_filter(js, lambda w: {HAS}))::DOUBLE / len(js) END AS skill, CASE WHEN len(js) = 0 THEN 0.0 ELSE len(list_intersect(js, cs))::DOUBLE / len(js) END AS ratio, CASE WHEN len({CRITICAL}) = 0 THEN 0.0 ELSE len(list_intersect({CRITICAL}, cs))::DOUBLE / len({CRITICAL}) END AS critical_coverage,
        list_sort(list_filter({CRITICAL}, lambda w: NOT list_contains(cs, w))) AS lacks_critical,
        CASE WHEN len(js) = 0 THEN 0.0 ELSE (coalesce({WEIGHT('list_intersect(js, cs)')}, 0) / {WEIGHT('js')})::DOUBLE END AS coverage, list_sort(list_filter(js, lambda w: NOT list_contains(cs, w))) AS lacks FROM combos),
    parts AS (SELECT job_id, candidate_id, skill, ratio, critical_coverage, coverage, lacks, lacks_critical, CASE WHEN min_experience IS NULL THEN 0.5 WHEN years IS NULL THEN 0.0 WHEN min_experience <= 0 THEN 1.0 ELSE least(1.0, years / min_experience) END AS exp,
        CASE WHEN years IS NULL THEN 0.4 WHEN years >= min_experience AND years <= min_experience + 2 THEN 1.0 WHEN years >= min_experience + 2 THEN 0.9 WHEN years >= min_experience - 1 THEN 0.7 ELSE 0.4 END AS band,
        CASE WHEN {DEGREE('education_required')} IS NULL THEN 0.5 WHEN {DEGREE('degree')} IS NULL THEN 0.0 WHEN {DEGREE('degree')} >= {DEGREE('education_required')} THEN 1.0 ELSE 0.0 END AS edu
        FROM pairs JOIN jobs USING (job_id) JOIN candidates USING (candidate_id) JOIN measured ON jobs.skills = s1 AND candidates.skills = s2), scored AS (SELECT *, {CLAMP('0.70 * skill + 0.20 * exp + 0.10 * edu')} AS weak FROM parts)"""


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n)})" for n in needles) + ")"


def _bucket(title: str) -> str:
    edge = f"starts_with({title}, 'ai ') OR starts_with({title}, 'ml ') OR ends_with({title}, ' ai') OR ends_with({title}, ' ml')"
    return "CASE " + " ".join(f"WHEN {_any(title, n)}{' OR ' + edge if k == 'ml' else ''} THEN '{k}'" for k, n in tx.ROLE_BUCKETS) + " ELSE 'other' END"


def _matches(bucket: str, hay: str) -> str:
    return f"CASE WHEN {bucket} = 'other' OR {hay} = '' THEN true " + " ".join(f"WHEN {bucket} = '{k}' THEN {'NOT ' + _any(hay, tx.REJECTED[k]) + ' AND ' if k in tx.REJECTED else ''}{_any(hay, a)}" for k, a in tx.ALLOWED.items()) + " ELSE true END"


def _contains_any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n)})" for n in needles) + ")"


def _counts(rules: dict[str, list[str]]) -> str:
    """For each rule how many of its parts lie in any of the list h."""
    return "[" + ", ".join(" + ".join(f"(len(list_filter(h, lambda x: contains(x, {_q(p)}))) > 0)::INT" for p in parts) for parts in rules.values()) + "]"


def _mended(c: str) -> str:
    for wrong, right in tx.MENDED.items():
        c = f"replace({c}, {_q(wrong)}, {_q(right)})"
    return c


def _spaced(c: str) -> str:
    c = f"replace(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    c = f"regexp_replace({c}, '[\u00a0\u2007\u202f]', ' ', 'g')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    return f"regexp_replace(regexp_replace({c}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"


def _joined(c: str) -> str:
    """Words that share a letter are joined by two passes."""
    return f"regexp_replace({c}, '([\\p{{L}}\\p{{M}}\\p{{Nd}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{M}}\\p{{Nd}}_])', '\\1\\2', 'g')"


def _pii(c: str) -> str:
    url = tx.URL.replace("'", "''")
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), {_q(tx.EMAIL)}, ' [EMAIL] ', 'g'), {_q(tx.PHONE)}, ' [PHONE] ', 'g'), '{url}', ' [URL] ', 'g'), '\\s+', ' ', 'g'))"


PCT = "CASE WHEN count(*) OVER () = 1 THEN 50.0 ELSE 100.0 * (rank() OVER (ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / (count(*) OVER () - 1) END".format
_DEGREE_TEXT = "trim(regexp_replace(lower(coalesce(degree, '')), '\\s+', ' ', 'g'))"
EDUCATION = f"CASE WHEN {_DEGREE_TEXT} = '' THEN 0.0 " + " ".join(f"WHEN regexp_matches({_DEGREE_TEXT}, {_q(p)}) THEN {level}" for level, p in rk.EDUCATION) + " ELSE 0.5 END"
PROFILE = f"""base AS (SELECT candidate_id, greatest(coalesce(years, 0.0), 0.0) AS y, len(list_filter(string_split_regex(skills, '[,;|]'), lambda x: trim(x) <> ''))::DOUBLE AS s, {EDUCATION} AS e, CASE WHEN trim(certifications) <> '' THEN 1.0 ELSE 0.0 END AS c FROM candidates),
    profile AS (SELECT candidate_id, round_even(({PCT('y')}) * 0.32 + ({PCT('s')}) * 0.32 + ({PCT('e')}) * 0.24 + ({PCT('c')}) * 0.12, 2) AS profile_score FROM base)"""
STOP = _list(lexical.STOP_WORDS)


def _tfidf(sides: str, k: int, least: int, share: float, terms: int | None) -> str:
    """Relations from sides (side, id, text) to nearest (query_id, rank, doc_id, score), to be followed by a SELECT."""
    most = "" if terms is None else f" ORDER BY sum(tf) DESC, encode(term) LIMIT {terms}"
    return f"""sides AS ({sides}), w AS (SELECT side, id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}}'), lambda x: NOT list_contains({STOP}, x)) AS w FROM sides),
    t AS (SELECT side, id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w),
    c AS (SELECT side, id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM sides),
    idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM c, n GROUP BY term, n HAVING count(*) >= {least} AND count(*) <= {share} * n{most}),
    x AS (SELECT side, id, term, tf * idf AS x FROM c JOIN idf USING (term)), u AS (SELECT side, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS x FROM x),
    s AS (SELECT q.id AS query_id, d.id AS doc_id, round_even(sum(q.x * d.x), 4) AS score FROM u q JOIN u d ON q.term = d.term AND q.side = 0 AND d.side = 1 GROUP BY ALL),
    nearest AS (SELECT query_id, row_number() OVER v::INT AS rank, doc_id, score FROM s WINDOW v AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER v <= {k})"""


ITEMS_AND_TEXTS = "SELECT 0 AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents"
#: The job's text and those of all candidates, whose 200 nearest are scored.
JOB_AND_POOL = "SELECT 0 AS side, job_id AS id, concat_ws(' ', title, skills, description) AS text FROM jobs WHERE job_id = 2 UNION ALL SELECT 1, candidate_id, concat_ws(' ', full_name, title, skills, text) FROM candidates LEFT JOIN documents ON doc_id = candidate_id"
NEAR = "near AS (SELECT 2::BIGINT AS job_id, candidate_id, coalesce(score, 0) AS cosine FROM candidates LEFT JOIN nearest ON doc_id = candidate_id ORDER BY cosine DESC, candidate_id LIMIT 200)"


BOOSTED = CLAMP("1 - pow(1 - " + CLAMP("greatest(score, 0.4 * score + 0.3 * similarity + 0.2 * skill + 0.1 * band)") + ", 2)")
EXPLAINED = f"{{0}}, explained AS (SELECT job_id, candidate_id, lacks, lacks_critical, {R4('ratio')} AS ratio, {R4('skill')} AS skill, {R4('coverage')} AS coverage, {R4('critical_coverage')} AS critical, {R4('exp')} AS exp, {R4('edu')} AS edu, {R4('weak')} AS weak, {R4('score')} AS raw, {R4(BOOSTED)} AS final FROM scored JOIN rankings USING (job_id, candidate_id))"
POOL = "listed AS (SELECT DISTINCT job_id, candidate_id FROM applicants WHERE status = 'shortlisted'), pool AS (SELECT * FROM rankings r WHERE EXISTS (SELECT 1 FROM listed l WHERE l.job_id = r.job_id AND l.candidate_id = r.candidate_id) OR NOT EXISTS (SELECT 1 FROM listed l WHERE l.job_id = r.job_id))"


def insight_sql() -> dict[str, str]:
    pct = "round_even(100 * least(1.0, greatest(0.0, {0})), 0)::BIGINT::VARCHAR".format
    years = lambda c: f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE format('{{:g}}', {c}) END"
    phrases = "list_filter(list_transform(string_split_regex(j.skills, '[,;\\n]+'), lambda x: trim(x)), lambda x: x <> '')"
    named = "list_filter(phrases, lambda x: list_contains(list_intersect(wanted, had), lower(x)))[1:6]"
    said = [
        f"a_name || ' is ranked #1 for ' || opening || ' because their overall match score is highest among shortlisted candidates (' || {pct('a_score')} || '%), with a ' || CASE WHEN a_score >= 0.78 THEN 'high' WHEN a_score >= 0.62 THEN 'medium' ELSE 'low' END || ' strength rating from the ranking model, supported by structured signals on skills coverage (' || {pct('a_ratio')} || '% of the job’s listed requirement tags found in their résumé skills), experience fit versus the role minimum (' || {pct('a_exp')} || '%), and education alignment (' || {pct('a_edu')} || '%).'",
        "CASE WHEN len(named) > 0 THEN 'Concrete alignment shows up in overlapping requirement areas such as ' || array_to_string(named, ', ') || ', drawn directly from the job’s stated skills and their résumé.' WHEN len(phrases) > 0 THEN 'Keyword-level tag overlap is not dominant in the parsed skills lists; the top rank is driven mainly by the full job description versus full résumé scoring, where this profile still separates from peers.' END",
        "'Their headline profile (' || title || ' / ' || role_label || ') reinforces domain relevance for this opening.'",
        f"CASE WHEN years + 1e-6 >= min_experience THEN 'They report about ' || {years('years')} || ' years of experience, meeting or exceeding the role’s stated minimum of ' || {years('min_experience')} || ' years, which supports depth expectations for delivery.' ELSE 'They report about ' || {years('years')} || ' years of experience in the structured profile fields used for screening.' END",
        "CASE WHEN degree <> '' THEN 'Education signals include ' || replace(degree, '_', ' ') || ' as the recorded highest degree.' END",
        "CASE WHEN certifications <> '' THEN 'Certifications/credentials on file include: ' || certifications END",
        f"'Compared with ' || b_name || ' at rank #2 (match score ' || {pct('b_score')} || '%, tagged skills coverage ' || {pct('b_ratio')} || '%), ' || a_name || ' leads on the model score gap and shows fewer uncovered requirement tags in the parsed job-versus-résumé view (' || a_lacks || ' missing vs ' || b_lacks || ' for #2), which is consistent with placing them ahead for this requisition.'",
        "'Overall, ' || a_name || ' combines the strongest automated match score with the most favorable structured overlap and experience/education signals in this shortlist, so they are positioned as the highest-impact choice for advancing ' || opening || '.'",
    ]
    top = "top AS (SELECT job_id, candidate_id, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, similarity DESC, candidate_id) AS place FROM pool QUALIFY place <= 2)"
    rows = "r AS (SELECT top.*, ratio, e.exp, e.edu, least(30, len(lacks)) AS lacks, full_name FROM top JOIN explained e USING (job_id, candidate_id) JOIN candidates USING (candidate_id))"
    both = f"""x AS (SELECT a.job_id, a.candidate_id, a.full_name AS a_name, a.score AS a_score, a.ratio AS a_ratio, a.exp AS a_exp, a.edu AS a_edu, a.lacks AS a_lacks, b.full_name AS b_name, b.score AS b_score, b.ratio AS b_ratio, b.lacks AS b_lacks,
        j.title AS opening, c.title, trim(c.role_label) AS role_label, c.years, trim(c.degree) AS degree, c.certifications, min_experience, {phrases} AS phrases, {TOKENS('j.skills')} AS wanted, {TOKENS('c.skills')} AS had
        FROM r a LEFT JOIN r b ON a.job_id = b.job_id AND b.place = 2 JOIN jobs j ON j.job_id = a.job_id JOIN candidates c ON c.candidate_id = a.candidate_id WHERE a.place = 1), y AS (SELECT *, {named} AS named FROM x)"""
    body = f"+{POOL}, {top}, {EXPLAINED.format(_scored('top'))}, {rows}, {both} SELECT job_id, candidate_id, md5(concat_ws(' ', {', '.join(said)})) AS insight FROM y"
    keys = "sha256(concat_ws('|', count(*), sum(('0x' || left(md5(candidate_id::VARCHAR), 12))::BIGINT)::VARCHAR, epoch(max(run_at))::BIGINT))"
    return {
        "top_candidate_insight": _with("rankings applicants jobs candidates", body),
        "insight_keys": _with("rankings applicants", f"+{POOL} SELECT job_id, {keys} AS insight_key FROM pool GROUP BY job_id"),
    }


#: Each candidate with each distinct requirement, and how many jobs have it.
ALL_PAIRS = f"""asks AS (SELECT skills AS wanted, min_experience AS least, education_required AS need, count(*) AS n FROM jobs GROUP BY ALL), js AS (SELECT DISTINCT wanted, {TOKENS('wanted')} AS js FROM asks), c1 AS (SELECT DISTINCT skills, {TOKENS('skills')} AS cs FROM candidates), c2 AS (SELECT *, {EXPAND('cs')} AS ce FROM c1),
    measured AS (SELECT wanted, c2.skills AS skills, CASE WHEN len(js) = 0 THEN 0.0 ELSE len(list_filter(js, lambda w: {HAS}))::DOUBLE / len(js) END AS skill FROM js, c2),
    parts AS (SELECT a.*, candidate_id, skill, CASE WHEN least IS NULL THEN 0.5 WHEN years IS NULL THEN 0.0 WHEN least <= 0 THEN 1.0 ELSE least(1.0, years / least) END AS exp, CASE WHEN {DEGREE('need')} IS NULL THEN 0.5 WHEN {DEGREE('degree')} IS NULL THEN 0.0 WHEN {DEGREE('degree')} >= {DEGREE('need')} THEN 1.0 ELSE 0.0 END AS edu
        FROM asks a, candidates c JOIN measured m ON m.wanted = a.wanted AND m.skills = c.skills),
    scored AS (SELECT *, round_even({CLAMP('0.70 * skill + 0.20 * exp + 0.10 * edu')}, 9) AS weak FROM parts)"""
BANDS = "d AS (SELECT floor(least(score, 0.99) * 3)::INT AS t, floor(least(similarity, 0.99) * 3)::INT AS p FROM rankings)"


def _dated(forms: list[str], number: str) -> str:
    out = _pick(forms, number)
    for letter, value in {"S": "strftime(l_shipdate, '%b %Y')", "E": "strftime(ends, '%B %Y')", "A": "year(l_shipdate)::VARCHAR", "B": "year(ends)::VARCHAR"}.items():
        out = f"regexp_replace({out}, '\\b{letter}\\b', {value}, 'g')"
    return out


def profile_sql() -> str:
    """Rows of jobs and schools; months and ranges of their dates by hand."""
    cut = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    has = lambda c, p: f"regexp_matches({c}, {_q(p)})"
    group = lambda c, p, g: f"nullif(regexp_extract({c}, {_q(p)}, {g}), '')::INT"
    month = lambda c: f"list_position({_list(dt.MONTHS)}, lower(left(regexp_extract({c}, {_q(dt.MONTH_YEAR)}, 1), 3)))"
    index = lambda c: f"CASE WHEN {has(c, dt.NOW)} THEN {b.NOW.year * 12 + b.NOW.month - 1} WHEN {month(c)} > 0 THEN {group(c, dt.MONTH_YEAR, 2)} * 12 + {month(c)} - 1 ELSE {group(c, dt.YEAR, 1)} * 12 END"
    parts = f"list_transform(string_split_regex(dates, {_q(dt.DASH)}), lambda x: {cut('x')})"
    ranged = lambda t: f"SELECT *, CASE WHEN e >= s THEN s || ':' || e END AS span FROM (SELECT *, {index('p[1]')} AS s, {index('p[2]')} AS e, lower({cut(chr(34) + 'k' + chr(34))}) AS key FROM (SELECT *, list_filter(ps, lambda x: x <> '') AS p, regexp_replace(regexp_replace(dates, '[–—]', '-', 'g'), '\\s+', ' ', 'g') AS k FROM (SELECT *, {parts} AS ps FROM {t})))"
    lines = "l AS (SELECT *, l_shipdate::DATE + to_months(l_quantity::INT) AS ends FROM lineitem)"
    jobs = f"j0 AS (SELECT l_orderkey AS person, l_linenumber AS row, {_dated(b.DATE_FORMS, 'l_partkey + l_linenumber')} AS dates, {_pick(b.ROLES, 'l_partkey + l_linenumber')} AS role, {_pick(b.COMPANIES, 'l_suppkey')} AS company FROM l)"
    schools = f"s0 AS (SELECT l_orderkey AS person, {_dated(b.SCHOOL_FORMS, 'l_suppkey')} AS dates FROM l WHERE l_linenumber % 2 = 1)"
    spelled = f"CASE WHEN {has('dates', dt.YEARS_MONTHS)} THEN coalesce({group('dates', dt.YEARS_MONTHS, 1)}, 0) * 12 + coalesce({group('dates', dt.YEARS_MONTHS, 2)}, 0) ELSE coalesce({group('dates', dt.YEARS, 1)}, 0) * 12 END"
    months = f"CASE WHEN {has('lower(dates)', dt.NO_DURATION)} THEN 0 WHEN len(ps) >= 2 AND e2 >= s2 THEN e2 - s2 ELSE {spelled} END"
    study = f"{has('lower(role || chr(10) || company)', dt.STUDY)} OR ({has('lower(role || chr(10) || company)', dt.DEGREE)} AND {has('lower(role || chr(10) || company)', dt.SCHOOL)}) OR {has('role', dt.DEGREE_ROLE)} OR ({has('role', dt.STUDENT)} AND {has('lower(role || chr(10) || company)', dt.SCHOOL)})"
    return f"""WITH {lines}, {jobs}, {schools}, j AS ({ranged('j0')}), s AS ({ranged('s0')}),
        kept AS (SELECT *, {index('ps[1]')} AS s2, {index('ps[2]')} AS e2 FROM j WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.person = j.person AND s.key <> '' AND s.key = j.key) AND NOT EXISTS (SELECT 1 FROM s WHERE s.person = j.person AND s.span = j.span))
        SELECT person, row, {months} AS months, {study} AS is_study FROM kept"""


def shortlist_sql(smart: str) -> dict[str, str]:
    listed = "p AS (SELECT job_id, candidate_id, max(status) AS status FROM applicants GROUP BY ALL), l AS (SELECT * FROM p WHERE status = 'shortlisted'), kept AS (SELECT * FROM l WHERE (job_id + candidate_id) % 5 <> 0)"
    fresh = "a AS (SELECT DISTINCT job_id, candidate_id FROM rankings WHERE score >= 0.9 AND candidate_id IN (SELECT candidate_id FROM candidates)), n AS (SELECT * FROM a ANTI JOIN kept USING (job_id, candidate_id))"
    views = {k: v for k, v in VIEWS.items() if k in ("jobs", "candidates", "applicants")}
    ranked = VIEWS["rankings"].replace("max(l_tax) * 10 AS similarity", "max(CASE WHEN l_partkey % 11 <> 0 THEN l_tax END) * 10 AS similarity")
    named = ", ".join(f"{k} AS ({v})" for k, v in {**views, "rankings": ranked}.items())
    return {
        "shortlist_changes": _with("applicants candidates rankings", f"+{listed}, {fresh} SELECT job_id, candidate_id, CASE WHEN n.job_id IS NOT NULL AND status IN ('new', 'screened') THEN 'shortlisted' ELSE status END AS status FROM p LEFT JOIN n USING (job_id, candidate_id) UNION ALL SELECT job_id, candidate_id, 'shortlisted' FROM n ANTI JOIN p USING (job_id, candidate_id)"),
        "shortlist_refresh": f"""WITH {named}, f AS (SELECT job_id, candidate_id FROM (WITH {smart})), t AS (SELECT job_id, candidate_id, similarity, false AS forced FROM f JOIN rankings USING (job_id, candidate_id) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, candidate_id) <= 2),
            o AS (SELECT job_id, candidate_id, coalesce(similarity, 0.0) AS similarity, true AS forced FROM (SELECT DISTINCT job_id, candidate_id FROM applicants) ANTI JOIN t USING (job_id, candidate_id) LEFT JOIN rankings USING (job_id, candidate_id)), both_ AS (SELECT * FROM t UNION ALL SELECT * FROM o)
            SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY forced, similarity DESC, candidate_id)::INT AS place, candidate_id, round_even(similarity, 4) AS similarity, forced, (SELECT count(*) FROM rankings) AS n_pool, (SELECT count(similarity) FROM rankings) AS n_with_similarity, (SELECT count(*) FROM f) AS n_passed, (SELECT count(*) FROM o) AS n_forced, (SELECT count(similarity) FROM rankings) - (SELECT count(*) FROM f) AS n_filtered_out FROM both_""",
        "pool_shown": _with("candidates rankings", "+b AS (SELECT candidate_id, max(score) AS score, max(similarity) AS similarity FROM rankings GROUP BY 1), s AS (SELECT candidate_id, score, row_number() OVER (ORDER BY score DESC, similarity DESC, candidate_id)::INT AS place FROM candidates JOIN b USING (candidate_id) WHERE workspace_id IS NULL AND contains(lower(concat_ws(' ', full_name, title, role_label, skills)), 'engineer') AND floor(score * 100 + 0.5) >= 60) SELECT place, candidate_id, round_even(score, 4) AS score FROM s WHERE place <= 40"),
        "application_scores": _with("rankings jobs clients applicants", "+w AS (SELECT job_id, candidate_id, score, 100 + candidate_id % 5 AS workspace_id FROM rankings UNION ALL SELECT job_id, candidate_id, score / 2, j.workspace_id FROM rankings JOIN jobs j USING (job_id) WHERE job_id % 3 = 0), r AS (SELECT job_id, candidate_id, score, w.workspace_id = j.workspace_id AS mine FROM w JOIN jobs j USING (job_id) QUALIFY row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY mine DESC, score DESC) = 1) SELECT job_id, candidate_id, j.title, coalesce(c.company_name, '') AS company, round_even(score * 100, 1) AS match_score, mine AS own_ranking, count(*) AS n, max(a.status) AS status FROM applicants a JOIN jobs j USING (job_id) LEFT JOIN clients c USING (client_id) LEFT JOIN r USING (job_id, candidate_id) GROUP BY ALL"),
    }


def ingestion_sql() -> dict[str, str]:
    kind = "CASE event_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in b.INGESTION_KINDS.items()) + " END"
    last = "row_number() OVER (PARTITION BY ingestion_id ORDER BY created_at DESC, event_id DESC) = 1"
    late = f"s.status = 'processing' AND s.updated_at <= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL {ingestion.STALE_MINUTES} MINUTE"
    external = "'u_' || left(sha256(text), 14)"
    uploads = f"""u AS (SELECT doc_id, doc_id % 2 * {b.SECOND_BATCH} + doc_id AS said, {external} AS external_id, {_pick(b.TITLES, 'doc_id')} AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'user' || doc_id || '@mail.org' END AS email, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 25)::INT END AS workspace_id FROM documents WHERE text IS NOT NULL)"""
    return {
        "ingestion_states": f"""WITH e AS (SELECT event_id, user_id * 5 + event_id % 5 AS ingestion_id, {kind} AS kind, CASE event_type WHEN 'error' THEN 'no text in ' || event_id ELSE '' END AS error, ts AS created_at FROM events),
            w AS (SELECT * FROM e WHERE kind IN ('start', 'finish', 'error') QUALIFY {last}), r AS (SELECT * FROM e WHERE kind IN ('submit', 'retry') QUALIFY {last}),
            t AS (SELECT ingestion_id, w.kind AS kind, w.error AS error, w.created_at AS told, r.created_at AS asked_at, w.event_id IS NULL OR coalesce((r.created_at, r.event_id) > (w.created_at, w.event_id), false) AS asked FROM w FULL JOIN r USING (ingestion_id)),
            s AS (SELECT *, CASE WHEN kind = 'finish' THEN 'done' WHEN asked THEN 'queued' WHEN kind = 'start' THEN 'processing' ELSE 'failed' END AS status, CASE WHEN asked AND kind IS DISTINCT FROM 'finish' THEN asked_at ELSE told END AS updated_at FROM t)
            SELECT ingestion_id, CASE WHEN {late} THEN 'failed' ELSE status END AS status, CASE WHEN {late} THEN {_q(ingestion.INTERRUPTED)} WHEN status = 'failed' THEN error ELSE '' END AS error, updated_at FROM s""",
        "candidate_upserts": f"WITH {uploads} SELECT external_id, arg_max('Name ' || doc_id, said) AS full_name, arg_max(title, said) AS title, coalesce(arg_max(email, said) FILTER (email <> ''), '') AS contact_email, 'new' AS status, arg_min(workspace_id, said) FILTER (workspace_id IS NOT NULL) AS workspace_id, count(*) AS n_uploads FROM u GROUP BY external_id",
        "hidden_candidates": f"WITH {uploads}, h AS (SELECT DISTINCT (doc_id % 25)::INT AS workspace_id, {external} AS external_id, CASE WHEN doc_id % 5 = 0 THEN {3 * b.SECOND_BATCH} ELSE {b.SECOND_BATCH} END AS at FROM documents) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.workspace_id = h.workspace_id AND u.external_id = h.external_id AND u.said >= h.at)",
    }


def oracle_sql() -> dict[str, str]:
    avg4 = lambda c: f"round_even(avg({c}), 4)"
    return {
        "funnel_global": _with("candidates applicants", f"+both_ AS (SELECT a.status, c.created_at FROM applicants a JOIN candidates c USING (candidate_id) UNION ALL SELECT status, created_at FROM {ORPHANS}), x AS (SELECT {EFFECTIVE} AS e FROM both_) SELECT {COUNTS} FROM x"),
        "funnel_per_job": _with("candidates applicants", f"+x0 AS (SELECT job_id, a.status, c.created_at FROM applicants a JOIN candidates c USING (candidate_id)), x AS (SELECT job_id, {EFFECTIVE} AS e FROM x0) SELECT job_id, {COUNTS} FROM x GROUP BY job_id"),
        "funnel_workspace": _with("candidates applicants jobs", f"+apps AS (SELECT j.workspace_id, candidate_id, lower(trim(a.status)) AS status, c.created_at, {PRIORITY.replace('status', 'a.status')} AS p FROM applicants a JOIN candidates c USING (candidate_id) JOIN jobs j USING (job_id)), best AS (SELECT workspace_id, status, created_at FROM apps QUALIFY row_number() OVER (PARTITION BY workspace_id, candidate_id ORDER BY p DESC, status, created_at) = 1), both_ AS (SELECT * FROM best UNION ALL SELECT workspace_id, status, created_at FROM {ORPHANS} AND workspace_id IS NOT NULL), x AS (SELECT workspace_id, {EFFECTIVE} AS e FROM both_) SELECT workspace_id, {COUNTS} FROM x GROUP BY workspace_id"),
        "stage_preview": _with("candidates applicants", f"+recent AS (SELECT * FROM applicants ORDER BY updated_at DESC, job_id, candidate_id, status LIMIT 1200), s AS (SELECT candidate_id, updated_at, {ALIASED} AS n FROM recent), p AS (SELECT CASE WHEN n = 'selected' THEN 'shortlisted' WHEN n IN ('new','screened','shortlisted','interviewing','hired','rejected') THEN n ELSE 'new' END AS stage, candidate_id, max(updated_at) AS u FROM s GROUP BY ALL), r AS (SELECT stage, candidate_id, row_number() OVER (PARTITION BY stage ORDER BY u DESC, candidate_id)::INT AS place FROM p) SELECT stage, place, candidate_id, full_name FROM r JOIN candidates USING (candidate_id) WHERE place <= 8"),
        "candidate_visibility": _with("candidates applicants rankings jobs hidden", "+v AS (SELECT workspace_id, candidate_id FROM candidates WHERE workspace_id IS NOT NULL UNION SELECT j.workspace_id, candidate_id FROM applicants JOIN jobs j USING (job_id) UNION SELECT j.workspace_id, candidate_id FROM rankings JOIN jobs j USING (job_id)) SELECT workspace_id, candidate_id FROM v WHERE EXISTS (SELECT 1 FROM candidates c WHERE c.candidate_id = v.candidate_id) AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.workspace_id = v.workspace_id AND h.candidate_id = v.candidate_id)"),
        "hire_time": _with("applicants jobs", "SELECT workspace_id, count(*) AS hires, round_even(avg(greatest(0, floor((epoch(a.updated_at) - epoch(j.created_at)) / 86400))), 4) AS avg_days FROM applicants a JOIN jobs j USING (job_id) WHERE a.status = 'hired' GROUP BY workspace_id"),
        "report_kpis": _with("applicants rankings jobs", f"+act AS (SELECT job_id FROM jobs WHERE status = 'active'), f AS (SELECT count(*) AS applications, count(DISTINCT candidate_id) AS applicants, count(*) FILTER (status IN {ADVANCED}) AS advanced, count(*) FILTER (status = 'hired') AS hires FROM applicants WHERE job_id IN (FROM act)), r AS (SELECT count(DISTINCT candidate_id) AS ranked, round_even(avg(score) * 100, 4) AS avg_match FROM rankings WHERE job_id IN (FROM act)) SELECT (SELECT count(*) FROM act) AS active_jobs, applications, applicants, advanced, hires, ranked, avg_match, coalesce(round_even(100.0 * hires / nullif(advanced, 0), 4), 0) AS shortlist_accuracy, 100 - coalesce(round_even(100.0 * advanced / nullif(applications, 0), 4), 0) AS time_saved FROM f, r"),
        "report_job_performance": _with("applicants rankings jobs", "+l AS (SELECT job_id, title FROM jobs ORDER BY created_at DESC, job_id LIMIT 15), s AS (SELECT job_id, round_even(avg(score) * 100, 4) AS a FROM rankings GROUP BY 1), h AS (SELECT job_id, count(*) AS n FROM applicants WHERE status = 'hired' GROUP BY 1) SELECT job_id, title, coalesce(a, 0.0) AS avg_score, coalesce(n, 0) AS hires FROM l LEFT JOIN s USING (job_id) LEFT JOIN h USING (job_id) ORDER BY hires DESC, avg_score DESC, job_id LIMIT 10"),
        "ai_vs_manual": _with("applicants rankings jobs", f"+m AS (SELECT DISTINCT j.workspace_id, candidate_id FROM applicants a JOIN jobs j USING (job_id) WHERE a.status IN {ADVANCED}), x AS (SELECT workspace_id, count(*) AS advanced, count(*) FILTER (candidate_id IN (SELECT candidate_id FROM rankings)) AS ai FROM m GROUP BY 1) SELECT workspace_id, advanced, ai, round_even(100.0 * ai / advanced, 4) AS ai_share FROM x"),
        "client_active_jobs": _with("clients jobs", "SELECT c.client_id, c.name, count(j.job_id) AS active_jobs FROM clients c LEFT JOIN jobs j ON j.client_id = c.client_id AND j.status = 'active' WHERE c.workspace_id = 7 OR c.client_id IN (SELECT client_id FROM jobs WHERE workspace_id = 7) GROUP BY ALL"),
        "job_status_pie": _with("jobs", "+n AS (SELECT workspace_id, status, count(*) AS n FROM jobs GROUP BY ALL) SELECT workspace_id, status, n, round_even(1000.0 * n / sum(n) OVER (PARTITION BY workspace_id), 0) / 10 AS share FROM n"),
        "dashboard_overview": _with("jobs candidates applicants", f"SELECT (SELECT count(*) FROM jobs WHERE status = 'active') AS active_jobs, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) FROM candidates WHERE created_at >= {NOW} - INTERVAL 1 DAY) AS new_candidates, (SELECT count(*) FROM applicants WHERE status = 'hired') AS hires"),
        "jobs_page_urgency": _with("jobs clients", "+f AS (SELECT * FROM jobs WHERE (title ILIKE '%engineer%' OR skills ILIKE '%engineer%') AND status IN ('active','on_hold')), p AS (SELECT job_id, client_id, title, status, urgency FROM f ORDER BY CASE urgency WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, job_id LIMIT 25 OFFSET 50) SELECT p.*, (SELECT count(*) FROM f) AS total, c.name AS client_name FROM p LEFT JOIN clients c USING (client_id)"),
        "candidates_page_search": _with("candidates", "+f AS (SELECT * FROM candidates WHERE (full_name ILIKE '%python%' OR title ILIKE '%python%' OR skills ILIKE '%python%' OR degree ILIKE '%python%') AND (status IS NULL OR lower(status) <> 'hired')) SELECT candidate_id, full_name, title, status, (SELECT count(*) FROM f) AS total FROM f ORDER BY lower(full_name), candidate_id LIMIT 25 OFFSET 25"),
        "applicant_list": _with("applicants rankings", "+l AS (SELECT job_id, candidate_id, status FROM applicants QUALIFY row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY updated_at DESC, status DESC) = 1) SELECT job_id, candidate_id, status, round_even(score, 4) AS score, round_even(similarity, 4) AS similarity FROM l LEFT JOIN rankings USING (job_id, candidate_id)"),
        "job_evaluations": _with("applicants rankings", "+a AS (SELECT DISTINCT job_id, candidate_id, true AS applied FROM applicants) SELECT candidate_id, job_id, coalesce(applied, false) AS applied, round_even(score, 4) AS score FROM a FULL JOIN rankings USING (job_id, candidate_id)"),
        "my_applications": _with("applicants rankings jobs clients", "+m AS (SELECT job_id, status FROM applicants WHERE candidate_id = 11 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, status DESC) = 1) SELECT job_id, title, c.name AS client_name, m.status, round_even(score, 4) AS score FROM m JOIN jobs USING (job_id) LEFT JOIN clients c USING (client_id) LEFT JOIN (SELECT job_id, score FROM rankings WHERE candidate_id = 11) USING (job_id)"),
        "duplicate_contacts": _with("candidates", "+k AS (SELECT candidate_id AS id, lower(replace(full_name, ' ', '.') || '@' || role_label || '.org') AS k FROM candidates), g AS (SELECT k, min(id) AS first_id, count(*) AS copies FROM k GROUP BY k HAVING count(*) > 1) SELECT id, first_id, copies, 'u_' || left(sha256(k), 14) AS contact FROM k JOIN g USING (k)"),
        "latest_ranking_activity": _with("rankings", "+l AS (SELECT * FROM rankings QUALIFY run_at = max(run_at) OVER (PARTITION BY job_id)) SELECT job_id, epoch(min(run_at))::BIGINT AS run_at, count(*) AS ranked, arg_min(candidate_id, (-score, candidate_id)) AS top_candidate FROM l GROUP BY job_id"),
        "profile_percentiles": _with("candidates", f"+{PROFILE} SELECT * FROM profile"),
        "competition_scores": _with("candidates rankings", f"+{PROFILE}, f AS (SELECT candidate_id, avg(score) * 100 AS fit FROM rankings GROUP BY 1) SELECT candidate_id, round_even(CASE WHEN fit IS NULL THEN profile_score ELSE 0.5 * profile_score + 0.5 * fit END, 6) AS competition_score FROM profile LEFT JOIN f USING (candidate_id)"),
        "best_job_per_candidate": _with("rankings applicants", "SELECT candidate_id, job_id AS best_job_id, round_even(100 * least(1.0, greatest(0.0, score)), 4) AS best_score FROM rankings r WHERE EXISTS (SELECT 1 FROM applicants a WHERE a.job_id = r.job_id AND a.candidate_id = r.candidate_id) QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) = 1"),
        "saved_rankings": _with("rankings", "SELECT job_id, row_number() OVER w::INT AS place, candidate_id, round_even(score, 4) AS score FROM rankings WINDOW w AS (PARTITION BY job_id ORDER BY score DESC, similarity DESC, candidate_id) QUALIFY row_number() OVER w <= 3"),
        "compare_candidates": _with("candidates clients rankings applicants jobs", "+best AS (SELECT candidate_id, job_id AS best_job_id, round_even(100 * least(1.0, greatest(0.0, score)), 4) AS best_score FROM rankings r WHERE EXISTS (SELECT 1 FROM applicants a WHERE a.job_id = r.job_id AND a.candidate_id = r.candidate_id) QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) = 1) SELECT candidate_id, full_name, years, degree, best_job_id, best_score, j.title AS job_title, c.name AS client_name FROM candidates LEFT JOIN best USING (candidate_id) LEFT JOIN jobs j ON j.job_id = best_job_id LEFT JOIN clients c USING (client_id) WHERE candidate_id IN (1, 2, 3, 4, 5, 6)"),
        "pair_weak_scores": _with("applicants jobs candidates", f"+{_scored('applicants')} SELECT job_id, candidate_id, {R4('skill')} AS skill, {R4('exp')} AS exp, {R4('edu')} AS edu, {R4('weak')} AS weak FROM scored"),
        "adjusted_scores": _with("rankings jobs candidates", f"+{_scored('rankings')}, f AS (SELECT job_id, candidate_id, {CLAMP('greatest(score, 0.4 * score + 0.3 * similarity + 0.2 * skill + 0.1 * band)')} AS x, {CLAMP('0.5 * similarity + 0.3 * skill + 0.2 * band')} AS blend FROM scored JOIN rankings USING (job_id, candidate_id)), g AS (SELECT *, {CLAMP('1 - pow(1 - x, 2)')} AS y FROM f) SELECT job_id, candidate_id, {R4('y')} AS final, {R4('blend')} AS blend, CASE WHEN {R4('100 * y')} >= 70 THEN 'Strong' WHEN {R4('100 * y')} >= 45 THEN 'Medium' ELSE 'Low' END AS label FROM g"),
        "ranking_explanations": _with("rankings jobs candidates", f"+{EXPLAINED.format(_scored('rankings'))} SELECT job_id, candidate_id, ratio AS skills_match_ratio, skill AS normalized_skill_overlap, coverage AS total_skill_coverage, critical AS critical_skill_coverage, exp AS experience_match, edu AS education_match, weak AS heuristic_weak_score, raw AS score_raw, final AS score, array_to_string(lacks[1:30], '|') AS missing_skills, array_to_string(lacks_critical[1:30], '|') AS missing_critical_skills FROM explained"),
        **insight_sql(),
        "smart_filter_pool": _with("rankings jobs candidates", f"+near AS (SELECT * FROM rankings WHERE similarity >= 0.05), {_scored('near')}, t AS (SELECT job_id, skill, {_bucket('lower(j.title)')} AS bucket, lower(c.title || ' ' || c.role_label) AS hay FROM scored JOIN jobs j USING (job_id) JOIN candidates c USING (candidate_id) WHERE skill >= 0.2) SELECT job_id, bucket, count(*) AS kept, {avg4('skill')} AS avg_skill FROM t WHERE {_matches('bucket', 'hay')} GROUP BY ALL"),
        "shortlist_compose": _with("rankings applicants", "+t AS (SELECT job_id, candidate_id, similarity, false AS forced FROM rankings WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, candidate_id) <= 2), f AS (SELECT DISTINCT a.job_id, a.candidate_id, r.similarity, true AS forced FROM applicants a LEFT JOIN rankings r USING (job_id, candidate_id) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.job_id = a.job_id AND t.candidate_id = a.candidate_id)) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY forced, similarity DESC NULLS LAST, candidate_id)::INT AS place, candidate_id, forced, round_even(similarity, 4) AS similarity FROM (FROM t UNION ALL FROM f)"),
        "final_ensemble": _with("rankings applicants jobs candidates", f"+{_scored('applicants')} SELECT job_id, candidate_id, round_even(0.2 * coalesce(weak, 0) + 0.3 * similarity + 0.5 * score + CASE WHEN contains(lower(coalesce(title, '')), 'backend') THEN 0.03 WHEN contains(lower(coalesce(title, '')), 'full stack') OR contains(lower(coalesce(title, '')), 'fullstack') THEN 0.015 ELSE 0 END::DOUBLE, 4) AS final_score FROM rankings LEFT JOIN scored USING (job_id, candidate_id) LEFT JOIN (SELECT candidate_id, title FROM candidates) USING (candidate_id)"),
        "hypothetical_rank": _with("rankings", "SELECT job_id, x, count(*) FILTER (score > x) + 1 AS place, count(*) AS pool FROM rankings, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS x) GROUP BY ALL"),
        "ranking_metrics": _with("rankings", "+r AS (SELECT candidate_id AS q, job_id AS i, score AS t, similarity AS p, row_number() OVER (PARTITION BY candidate_id ORDER BY similarity DESC, job_id) AS place, rank() OVER (PARTITION BY candidate_id ORDER BY score) + (count(*) OVER (PARTITION BY candidate_id, score) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY candidate_id ORDER BY similarity) + (count(*) OVER (PARTITION BY candidate_id, similarity) - 1) / 2.0 AS rp, (score >= 0.5)::INT AS hit FROM rankings), s AS (SELECT *, place <= 10 AS top, row_number() OVER (PARTITION BY q, place <= 10 ORDER BY t DESC, i) AS ideal, sum(hit) OVER (PARTITION BY q ORDER BY place) / place AS ph FROM r), e AS (SELECT q, corr(rt, rp) AS spearman, sum(t / log2(place + 1)) FILTER (top) / nullif(sum(t / log2(ideal + 1)) FILTER (top), 0) AS ndcg, coalesce(sum(hit) FILTER (top), 0) / least(10, count(*)) AS precision, coalesce(sum(hit) FILTER (top), 0) / nullif(sum(hit), 0) AS recall, sum(hit * ph) / nullif(sum(hit), 0) AS ap FROM s GROUP BY q) SELECT count(*) AS queries, round_even(avg(spearman) FILTER (NOT isnan(spearman)), 4) AS spearman, round_even(avg(coalesce(ndcg, 0)), 4) AS ndcg, round_even(avg(precision), 4) AS precision, round_even(avg(coalesce(recall, 0)), 4) AS recall, round_even(avg(coalesce(ap, 0)), 4) AS ap FROM e"),
        "classification_report": _with("rankings", "+d AS (SELECT floor(least(score, 0.99) * 3)::INT AS t, floor(least(similarity, 0.99) * 3)::INT AS p FROM rankings), l AS (SELECT t AS label FROM d UNION SELECT p FROM d), n AS (SELECT label, (SELECT count(*) FROM d WHERE t = label) AS support, (SELECT count(*) FROM d WHERE p = label) AS said, (SELECT count(*) FROM d WHERE t = label AND p = label) AS hit FROM l), m AS (SELECT label, support, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM n) SELECT label, support, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m"),
        "regression_metrics": _with("rankings", "SELECT count(*) AS n, round_even(avg((similarity - score) * (similarity - score)), 4) AS mse, round_even(avg(abs(similarity - score)), 4) AS mae FROM rankings"),
        "classification_summary": _with("rankings", f"+{BANDS}, l AS (SELECT t AS label FROM d UNION SELECT p FROM d), c AS (SELECT label, (SELECT count(*) FROM d WHERE t = label) AS support, (SELECT count(*) FROM d WHERE p = label) AS said, (SELECT count(*) FROM d WHERE t = label AND p = label) AS hit FROM l), m AS (SELECT coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM c), a AS (SELECT {avg4('(t = p)::INT')} AS a FROM d) SELECT (SELECT count(*) FROM d) AS n, (FROM a) AS accuracy, {avg4('p')} AS macro_precision, {avg4('r')} AS macro_recall, {avg4('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS macro_f1, (FROM a) AS micro_f1 FROM m"),
        "confusion_matrix": _with("rankings", f"+{BANDS}, l AS (SELECT t AS label FROM d UNION SELECT p FROM d) SELECT a.label AS truth, b.label AS predicted, (SELECT count(*) FROM d WHERE t = a.label AND p = b.label) AS n FROM l a, l b"),
        "rank_correlation": _with("rankings", "+r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS t, rank() OVER (ORDER BY similarity) + (count(*) OVER (PARTITION BY similarity) - 1) / 2.0 AS p FROM rankings) SELECT count(*) AS n, round_even(corr(t, p), 4) AS spearman FROM r"),
        "split_stratified": "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, unnest(['train', 'val', 'test']) AS split, unnest([floor(0.8 * n)::BIGINT, floor(0.9 * n)::BIGINT - floor(0.8 * n)::BIGINT, n - floor(0.9 * n)::BIGINT]) AS n FROM n) SELECT * FROM s WHERE n > 0",
        "feedback_labels_latest": f"WITH f AS (SELECT doc_id % 40 AS job_id, doc_id AS candidate_id, replace(lower(trim(CASE WHEN doc_id % 2 = 0 THEN 'not_a_fit' ELSE {_pick(b.ACTIONS, 'doc_id')} END)), ' ', '_') AS action FROM labels) SELECT *, CASE WHEN action IN ('selected', 'hired', 'hired_interest', 'hire', 'yes') THEN 1.0 WHEN action IN ('shortlisted', 'shortlist') THEN 0.85 ELSE 0.0 END::DOUBLE AS label FROM f WHERE action IN ('selected', 'hired', 'hired_interest', 'hire', 'yes', 'shortlisted', 'shortlist', 'rejected', 'reject', 'not_a_fit', 'no', 'dismissed')",
        "feedback_status": f"WITH a AS (SELECT doc_id, lower(trim({_pick(b.ACTIONS, 'doc_id')})) AS a FROM labels), r AS (SELECT doc_id, CASE WHEN a IN ('not_a_fit', 'not a fit', 'reject') THEN 'rejected' ELSE a END AS a FROM a), p AS (SELECT doc_id, a, trim(regexp_replace(a, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_') AS p FROM r) SELECT doc_id, CASE WHEN a = '' THEN 'new' WHEN p = '' THEN 'reviewed' ELSE p[1:64] END AS status FROM p",
        "jobs_filtered": _with("jobs", "SELECT job_id, status, title FROM jobs WHERE status IN ('on_hold', 'inactive') AND created_at >= TIMESTAMP '1995-03-01' AND created_at <= TIMESTAMP '1996-06-30 23:59:59'"),
        "job_requirements": _with("jobs", f"SELECT job_id, coalesce({', '.join(f'nullif(regexp_extract(lower(description), {_q(p)}, {g}), {_q('')})::INT' for p, g in tx.YEARS_ASKED)}, list_min(list_transform(regexp_extract_all(lower(description), {_q(tx.ANY_YEARS)}, 1), lambda x: x::INT))) AS min_years, CASE {' '.join(f'WHEN regexp_matches(lower(description), {_q(p)}) THEN {_q(n)}' for n, p in tx.DEGREE_ASKED)} ELSE 'any' END AS degree FROM jobs"),
        "role_fine": _with("candidates", f"+b AS (SELECT candidate_id, lower(title) AS t, lower(skills) || ' ' || lower(role_label) AS st, list_transform(string_split(skills, ','), lambda x: trim(lower(x))) AS h FROM candidates), w AS (SELECT *, t || ' ' || st AS w FROM b), n AS (SELECT candidate_id, {_counts(tx.TITLE_SKILLS)} AS n, * EXCLUDE candidate_id FROM w) SELECT candidate_id, CASE WHEN regexp_matches(t, {_q(tx.QA_WORK)}) THEN 'qa' WHEN regexp_matches(st, {_q(tx.BACKEND_WORK)}) AND regexp_matches(st, {_q(tx.FRONTEND_WORK)}) THEN 'fullstack' WHEN regexp_matches(st, {_q(tx.BACKEND_WORK)}) THEN 'backend' WHEN regexp_matches(st, {_q(tx.FRONTEND_WORK)}) THEN 'frontend' WHEN {_contains_any('t', tx.SOFTWARE_TITLES)} THEN 'software' WHEN regexp_matches(w, {_q(tx.DATA_WORK)}) THEN 'data' WHEN regexp_matches(w, {_q(tx.MOBILE_WORK)}) THEN 'software' WHEN regexp_matches(st, {_q(tx.QA_WORK)}) THEN 'qa' ELSE 'other' END AS role, CASE WHEN list_max(n) = 0 THEN 'unknown' ELSE ({_list(list(tx.TITLE_SKILLS))})[list_position(n, list_max(n))] END AS title_from_skills FROM n"),
        "resume_text": f"WITH m AS (SELECT doc_id, {_mended('text')} AS t FROM documents), a AS (SELECT doc_id, {_spaced('t')} AS t FROM m), j AS (SELECT doc_id, {_joined(_joined('t'))} AS t FROM a) SELECT doc_id, md5({_spaced('t')}) AS clean_md5 FROM j",
        "pool_rank": _with("candidates", "+p AS (SELECT years / 50 AS score, length(trim(concat_ws(' ', full_name, title, skills))) >= 30 AS enough FROM candidates WHERE workspace_id = 7 ORDER BY created_at DESC, candidate_id LIMIT 60) SELECT count(*) FILTER (enough AND score > 0.75) + 1 AS position, count(*) FILTER (enough) AS ranked, count(*) >= 60 AS capped, count(*) AS considered FROM p"),
        "cosine_top_k": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id, round_even(list_inner_product(d.v, q.v) / (sqrt(list_inner_product(d.v, d.v)) * sqrt(list_inner_product(q.v, q.v)) + 1e-12), 4) AS score FROM v d, v q WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id) SELECT query_id, row_number() OVER w::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5",
        "tfidf_top_k": f"WITH {_tfidf(ITEMS_AND_TEXTS, 5, 2, 0.95, None)} SELECT * FROM nearest",
        "tfidf_common_terms": f"WITH {_tfidf(ITEMS_AND_TEXTS, 10, 1, 1.0, lexical.PREFILTER_TERMS)} SELECT * FROM nearest",
        "ranked_pool": _with("jobs candidates", f"+{_tfidf(JOB_AND_POOL, 200, 1, 1.0, lexical.PREFILTER_TERMS)}, {NEAR}, {_scored('near')}, r AS (SELECT candidate_id, cosine, (cosine + 1) / 2 AS raw, skill, band FROM scored JOIN near USING (job_id, candidate_id)), f AS (SELECT candidate_id, cosine, {CLAMP('greatest(raw, 0.4 * raw + 0.2 * skill + 0.1 * band)')} AS x FROM r), g AS (SELECT candidate_id, cosine, {R4(CLAMP('1 - pow(1 - x, 2)'))} AS score FROM f) SELECT row_number() OVER (ORDER BY score DESC, candidate_id)::INT AS place, candidate_id, cosine, score FROM g QUALIFY place <= 50"),
        "skill_vocab": "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) SELECT word, count(*) AS doc_freq FROM w GROUP BY word HAVING count(*) >= 12 ORDER BY doc_freq DESC, word LIMIT 4000",
        "document_skills": "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), v AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 12 ORDER BY count(*) DESC, word LIMIT 4000), f AS (SELECT doc_id, array_to_string(list_sort(list(word))[1:80], '|') AS skills FROM w SEMI JOIN v USING (word) GROUP BY doc_id) SELECT doc_id, coalesce(skills, '') AS skills FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN f USING (doc_id)",
        "ngram_discovery": "WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), g AS (SELECT 2 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM w UNION ALL SELECT 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w), c AS (SELECT n, ngram, count(*) AS freq FROM g GROUP BY ALL) SELECT n, ngram, freq FROM c QUALIFY row_number() OVER (PARTITION BY n ORDER BY freq DESC, ngram) <= CASE n WHEN 2 THEN 600 ELSE 400 END",
        "pii_strip": f"SELECT doc_id, md5({_pii('text')}) AS clean_md5 FROM documents",
        "pii_audit": f"SELECT lang, count(*) AS texts, count(*) FILTER (regexp_matches(text, {_q(tx.EMAIL)}) OR regexp_matches(text, {_q(tx.PHONE)}) OR regexp_matches(text, {_q(tx.URL)})) AS with_pii FROM documents GROUP BY lang",
        "interval_union_years": "WITH r AS (SELECT l_partkey AS key, year(l_shipdate) AS s, year(l_shipdate) + l_linenumber % 3 AS e FROM lineitem), y AS (SELECT DISTINCT key, unnest(range(s, e)) AS y FROM r) SELECT key, least(40, count(y)) AS years FROM (SELECT DISTINCT key FROM r) LEFT JOIN y USING (key) GROUP BY key",
        "inbox_threads": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS incoming, max(turn) AS last_turn, arg_max(role, (turn, role)) AS last_role FROM conversations GROUP BY conv_id",
        "ingestion_rollup": _with("activity", "+q AS (SELECT created_at::DATE::VARCHAR AS batch_id, CASE WHEN kind IN ('signup','click') THEN 'queued' WHEN kind = 'view' THEN CASE WHEN created_at <= TIMESTAMP '2024-01-30 11:40:00' THEN 'failed' ELSE 'processing' END WHEN kind = 'purchase' THEN 'done' ELSE 'failed' END AS s FROM activity) SELECT batch_id, count(*) AS total, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed FROM q GROUP BY batch_id"),
        **inbox_oracles.oracle_sql(VIEWS),
        **name_oracles.oracle_sql(),
        **address_oracles.oracle_sql(),
        **education_oracles.oracle_sql(),
        **ingestion_sql(),
        **shortlist_sql(resume_oracles.smart(_bucket("lower(jt)"), _matches("bucket", "hay"))),
        "jobs_alone": profile_sql(),
        "best_candidates": _with("jobs candidates", f"+{ALL_PAIRS}, t AS (SELECT wanted, least, need, candidate_id, skill, exp, edu, weak, row_number() OVER (PARTITION BY wanted, least, need ORDER BY weak DESC, candidate_id)::INT AS place FROM scored QUALIFY place <= 5) SELECT job_id, place, candidate_id, {R4('t.skill')} AS skill, {R4('exp')} AS exp, {R4('edu')} AS edu, {R4('weak')} AS weak FROM jobs j JOIN t ON j.skills = wanted AND j.min_experience = least AND j.education_required = need"),
        "mean_job_scores": _with("jobs candidates", f"+{ALL_PAIRS} SELECT candidate_id, round_even(sum(weak * n) / sum(n), 6) AS mean_score FROM scored GROUP BY candidate_id"),
        "refreshed_rankings": _with("rankings jobs candidates", f"+{_scored('rankings')}, f AS (SELECT workspace_id, job_id, candidate_id, round_even({BOOSTED}, 9) AS score, similarity FROM scored JOIN rankings USING (job_id, candidate_id) JOIN jobs USING (job_id)) SELECT workspace_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, similarity DESC, candidate_id)::INT AS place, candidate_id, score, similarity FROM f"),
        "stream_activity_windows": _with("activity", "SELECT epoch(date_trunc('day', created_at))::BIGINT AS window_start, kind, count(*) AS n, round_even(sum(value), 4) AS value FROM activity GROUP BY ALL"),
    } | resume_oracles.oracle_sql(VIEWS, _bucket, _matches)
