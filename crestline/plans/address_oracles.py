"""The addresses of scanned texts as DuckDB SQL."""

from __future__ import annotations

from crestline.functions import resume as rs
from crestline.functions import text as tx
from crestline.plans import bindings as b
from crestline.plans.name_oracles import OWN_WORDS, filled
from crestline.plans.resume_oracles import EMAILS, NL, _all, has, q, scannable, sub, trimmed

WHOLE = f"list_filter(list_transform(list_concat({_all('t', tx.EMAIL, 0)}, {_all('t', rs.TOKEN, 1)}), lambda a: lower(a)), lambda a: length(a) BETWEEN 5 AND {rs.LONGEST_ADDRESS} AND NOT {has('a', rs.NOBODY)})"
HEAD = "(?is)\\n\\s*" + rs.HEAD_END + ".*"
MAILBOX = f"NOT contains(own[place], '@') AND {has('own[place - 1]', rs.MAILBOX)} AND length(own[place - 1]) <= {rs.LONGEST_MAILBOX} AND ({has('own[place - 1]', '[0-9.]')} OR length(own[place - 1]) >= 4)"


def oracle_sql() -> dict[str, str]:
    return {
        "scanned_addresses": f"""WITH {OWN_WORDS}, texts AS (SELECT doc_id, {filled(b.ADDRESS_TOPS, 'doc_id')} || body || {filled(b.ADDRESS_TAILS, 'doc_id // 11')} AS text FROM named),
    s AS (SELECT doc_id, {scannable(f'substring(text, 1, {rs.HEAD})')} AS t FROM texts), e AS (SELECT doc_id, ({EMAILS})[1] AS email FROM s),
    long AS (SELECT doc_id, {scannable('text')} AS t FROM texts WHERE length(text) > {rs.HEAD}), r AS (SELECT doc_id, ({EMAILS})[1] AS later FROM long),
    l AS (SELECT doc_id, (list_filter(list_transform(string_split(regexp_replace(t, {q(HEAD)}, ''), {NL}), lambda x: {trimmed('x')}), lambda x: x <> ''))[1:{rs.HEAD_LINES}] AS own FROM s),
    h AS (SELECT doc_id, own, list_position(list_transform(own, lambda x: {has('x', rs.HOST_LINE)}), true) AS place FROM l),
    p AS (SELECT doc_id, own, CASE WHEN place > 1 AND {MAILBOX} THEN place - 1 ELSE place END AS f FROM h WHERE place > 0), c AS (SELECT doc_id, own[f:f + {rs.ADDRESS_LINES - 1}] AS part FROM p),
    d AS (SELECT doc_id, part, coalesce(list_position(list_transform(part, lambda x: {has('x', '(?i)^' + rs.HEAD_END)}), true), 0) AS e FROM c),
    j AS (SELECT doc_id, {sub(scannable("array_to_string(CASE WHEN e > 0 THEN part[1:e - 1] ELSE part END, ' ')"), chr(92) + 's+', '')} AS t FROM d), w AS (SELECT doc_id, ({WHOLE})[1] AS joined FROM j)
    SELECT doc_id, coalesce(email, joined, later, '') AS email FROM e LEFT JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)""",
    }
