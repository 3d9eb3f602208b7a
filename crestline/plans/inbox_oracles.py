"""Notifications, the inbox and backfills as DuckDB SQL."""

from __future__ import annotations

from crestline.plans import bindings as b
from crestline.plans.resume_oracles import NL, pick, trimmed

SINCE = f"TIMESTAMP '{b.INBOX_NOW.isoformat(' ')}' - INTERVAL 14 DAY"


def text_of(c: str) -> str:
    return trimmed(f"coalesce({c}, '')")


def or_else(c: str, other: str) -> str:
    return f"coalesce(nullif({text_of(c)}, ''), {other})"


VIEWS = {
    "logged": f"SELECT event_id, CASE kind WHEN 'error' THEN 'upload' ELSE kind END AS kind, {pick(b.MESSAGES, 'event_id')} AS message, CASE WHEN event_id % 3 = 0 THEN '/pool' END AS href, created_at, workspace_id FROM activity",
    "feedback": f"SELECT job_id * 1000000 + candidate_id AS feedback_id, job_id, candidate_id, {pick(b.ACTIONS, '(job_id + candidate_id)')} AS action, max(updated_at) AS created_at FROM applicants GROUP BY job_id, candidate_id",
    "users": "SELECT c_custkey AS user_id, 'User' || c_custkey || '@mail.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS full_name FROM customer",
    "messages": f"""SELECT conv_id * 1000 + turn AS message_id, CASE WHEN role <> 'user' THEN 7 ELSE conv_id % 30 + 1 END AS sender_id, CASE WHEN role <> 'user' THEN conv_id % 30 + 1 ELSE 7 END AS recipient_id, {pick(b.SUBJECTS, '(conv_id + turn)')} AS subject, text AS body,
        {pick(b.CHAT_SCOPES, 'conv_id')} AS chat_scope, 1704067200 + conv_id % 5000 * 7200 + turn * 60 AS t, turn % 4 = 0 AS seen, conv_id % 7 = 0 AS hs, conv_id % 5 = 0 AS hr FROM conversations""",
}
LOW = f"lower({text_of('message')})"
ACTION = f"lower({text_of('action')})"
KIND = f"CASE WHEN {ACTION} IN ('shortlisted', 'shortlist') THEN 'shortlist' WHEN {ACTION} IN ('selected', 'select') THEN 'select' WHEN {ACTION} IN ('rejected', 'reject', 'not_a_fit') THEN 'reject' ELSE 'feedback' END"
NAME = or_else("full_name", "'A candidate'")
FEED = f"""ev AS (SELECT * FROM logged WHERE workspace_id = 7 ORDER BY created_at DESC, event_id LIMIT 40), nj AS (SELECT * FROM jobs WHERE workspace_id = 7 AND created_at >= {SINCE} ORDER BY created_at DESC, job_id LIMIT 12),
    runs AS (SELECT job_id, max(run_at) AS run FROM rankings GROUP BY job_id ORDER BY run DESC, job_id LIMIT 12), rr AS (SELECT job_id, run, title FROM runs JOIN jobs USING (job_id) WHERE workspace_id = 7),
    rn AS (SELECT rr.job_id, run, title, count(*) AS n, arg_min(candidate_id, (-score, -similarity, candidate_id)) AS candidate_id FROM rr JOIN rankings r ON r.job_id = rr.job_id AND r.run_at = run GROUP BY ALL),
    fb AS (SELECT f.*, title FROM feedback f JOIN jobs j USING (job_id) WHERE f.created_at >= {SINCE} AND workspace_id = 7 ORDER BY f.created_at DESC, feedback_id LIMIT 25),
    feed AS (SELECT * FROM (
        SELECT 0 AS source, 'event-' || event_id AS id, kind, {or_else('message', "'Update'")} AS message, floor(epoch(created_at))::BIGINT AS "at", href FROM ev WHERE kind <> 'upload' AND NOT contains({LOW}, 'upload queued:') AND NOT contains({LOW}, 'processing upload:') AND NOT starts_with({LOW}, 'resume upload (')
        UNION ALL SELECT 1, 'job-' || job_id, 'job', 'New job: ' || title, floor(epoch(created_at))::BIGINT, '/jobs/' || job_id FROM nj
        UNION ALL SELECT 2, 'rank-' || job_id || '-' || strftime(run, '%Y-%m-%dT%H:%M:%S'), 'ranking', 'Ranking updated for ' || rn.title || ' (' || n || ' candidates scored) — top match: ' || full_name, floor(epoch(run))::BIGINT, '/jobs?job=' || job_id FROM rn JOIN candidates USING (candidate_id)
        UNION ALL SELECT 3, 'feedback-' || feedback_id, {KIND}, CASE {KIND} WHEN 'shortlist' THEN {NAME} || ' shortlisted for ' || title WHEN 'select' THEN {NAME} || ' marked as selected for ' || title WHEN 'reject' THEN {NAME} || ' marked not a fit for ' || title ELSE {NAME} || ': ' || CASE WHEN action = '' THEN 'update' ELSE action END || ' — ' || title END,
            floor(epoch(created_at))::BIGINT, '/jobs/' || job_id FROM (SELECT fb.*, full_name FROM fb LEFT JOIN candidates USING (candidate_id))) ORDER BY "at" DESC, source, id LIMIT 80)"""
LINE = f"concat_ws(': ', nullif({text_of('subject')}, ''), nullif({text_of('body')}, ''))"
SCOPE = f"CASE WHEN lower(trim(chat_scope)) IN {tuple(['general', 'candidates', 'clients'])} THEN lower(trim(chat_scope)) ELSE 'general' END"
ROWS = f"""mi AS (SELECT 'in' AS direction, message_id, subject, body, t, seen AS "read", {SCOPE} AS chat_scope, email FROM messages JOIN users ON user_id = sender_id WHERE recipient_id = 7 AND NOT hr ORDER BY t DESC, message_id LIMIT 60),
    mo AS (SELECT 'out' AS direction, message_id, subject, body, t, true AS "read", {SCOPE} AS chat_scope, email FROM messages JOIN users ON user_id = recipient_id WHERE sender_id = 7 AND NOT hs ORDER BY t DESC, message_id LIMIT 60),
    cl AS (SELECT 'user' || client_id % 20 || '@mail.org' AS a, arg_max(coalesce(nullif(CASE WHEN client_id % 4 = 0 THEN '' ELSE name END, ''), nullif(CASE WHEN client_id % 8 = 0 THEN '' ELSE company_name END, ''), 'user' || client_id % 20 || '@mail.org'), client_id) AS n, max(client_id) AS id FROM clients GROUP BY 1),
    ca AS (SELECT 'user' || candidate_id % 25 || '@mail.org' AS a, arg_min(full_name, (created_at, candidate_id)) AS n, arg_min(candidate_id, (created_at, candidate_id)) AS id FROM candidates GROUP BY 1),
    m AS (SELECT x.*, {LINE} AS line, CASE WHEN chat_scope = 'clients' THEN '/clients/' || cl.id WHEN chat_scope = 'candidates' THEN '/candidates/' || ca.id END AS peer_path,
        coalesce(CASE WHEN chat_scope = 'clients' THEN cl.n WHEN chat_scope = 'candidates' THEN ca.n END, nullif(u.full_name, ''), x.email) AS peer_name FROM (FROM mi UNION ALL FROM mo) x LEFT JOIN cl ON cl.a = lower(x.email) LEFT JOIN ca ON ca.a = lower(x.email) LEFT JOIN users u ON lower(u.email) = lower(x.email))
    SELECT id, kind, message, "at", source = 0 AND split_part(id, '-', 2)::BIGINT % 2 = 0 AS "read", false AS direct, NULL::VARCHAR AS direction, NULL::VARCHAR AS peer_email, NULL::VARCHAR AS chat_scope, NULL::VARCHAR AS peer_name, NULL::VARCHAR AS peer_path, true AS in_alerts, false AS in_candidates FROM feed
    UNION ALL SELECT 'msg-' || message_id, 'message', CASE direction WHEN 'in' THEN 'New message from ' ELSE 'Message to ' END || peer_name || ' — ' || CASE WHEN length(line) > 200 THEN substring(line, 1, 199) || '…' WHEN line = '' THEN '(empty message)' ELSE line END, t, "read", true, direction, email, chat_scope, peer_name, peer_path, false, chat_scope = 'candidates' FROM m"""


def oracle_sql(views: dict[str, str]) -> dict[str, str]:
    known = views | VIEWS
    with_ = lambda names, body: "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in names.split()) + ", " + body
    fed = "activity logged jobs applicants feedback rankings candidates"
    best = "best AS (SELECT candidate_id, job_id AS best_job_id, round_even(100 * least(1.0, greatest(0.0, score)), 4) AS best_score FROM rankings r WHERE EXISTS (SELECT 1 FROM applicants a WHERE a.job_id = r.job_id AND a.candidate_id = r.candidate_id) QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) = 1)"
    return {
        "workspace_backfill": with_("candidates applicants rankings jobs", "l AS (SELECT 0 AS p, job_id, candidate_id FROM applicants WHERE status = 'hired' UNION ALL SELECT 1, job_id, candidate_id FROM rankings UNION ALL SELECT 2, job_id, candidate_id FROM applicants) SELECT c.candidate_id, arg_min(j.workspace_id, (p, l.job_id)) AS workspace_id FROM candidates c JOIN l USING (candidate_id) JOIN jobs j ON j.job_id = l.job_id WHERE c.workspace_id IS NULL GROUP BY 1"),
        "workspace_best_jobs": with_("rankings jobs", "o AS (SELECT r.* FROM rankings r JOIN jobs USING (job_id) WHERE workspace_id = 7) SELECT candidate_id, job_id AS best_job_id, round_even(least(100.0, 100 * score), 4) AS best_score FROM o QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) = 1"),
        "best_job_changes": with_("rankings applicants", f"{best} SELECT * FROM best WHERE candidate_id % 7 = 0 OR candidate_id % 3 = 1 OR candidate_id % 5 = 0"),
        "feedback_export": with_("applicants feedback rankings candidates", f"n AS (SELECT *, {pick(b.BODIES, 'feedback_id')} AS note FROM feedback) SELECT feedback_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, job_id::VARCHAR AS job, CASE WHEN candidate_id % 9 <> 0 THEN candidate_id::VARCHAR ELSE '' END AS candidate, action, round_even(score, 4) AS score, replace(note, {NL}, ' ')[:500] AS notes FROM n LEFT JOIN rankings USING (job_id, candidate_id)"),
        "pairs_sample": with_("rankings", "s AS (SELECT job_id, candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY md5(job_id::VARCHAR), job_id) AS p FROM rankings) SELECT job_id, candidate_id FROM s WHERE p <= 3"),
        "job_board": with_("jobs clients applicants", "f AS (SELECT *, count(*) OVER () AS total FROM jobs WHERE status = 'active' AND (title ILIKE '%engineer%' OR skills ILIKE '%engineer%' OR description ILIKE '%engineer%') ORDER BY created_at DESC, job_id LIMIT 50) SELECT job_id, title, company_name AS firm, total, EXISTS (SELECT 1 FROM applicants a WHERE a.job_id = f.job_id AND a.candidate_id = 11) AS applied FROM f JOIN clients USING (client_id)"),
        "activity_feed": with_(fed, f"{FEED} SELECT * FROM feed"),
        "inbox_rows": with_(f"{fed} clients users messages", f"{FEED}, {ROWS}"),
    }
