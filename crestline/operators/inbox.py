"""Notifications of a workspace from four sources, and an inbox of notifications and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.resume import trimmed

#: How many of the newest each source gives, how many there are in all, and how far back jobs and feedback go.
NEWEST = {"event": 40, "job": 12, "ranking": 12, "feedback": 25}
MOST, HORIZON_DAYS = 80, 14
MOST_MESSAGES, LONGEST_PREVIEW = 60, 200
SCOPES = ["general", "candidates", "clients"]
#: What actions of feedback are shown as, and how that is said.
FEEDBACK_KINDS = {"shortlist": ["shortlisted", "shortlist"], "select": ["selected", "select"], "reject": ["rejected", "reject", "not_a_fit"]}
FEEDBACK_WORDS = {"shortlist": " shortlisted for ", "select": " marked as selected for ", "reject": " marked not a fit for "}
#: Messages that are noise hold one of the first or begin with the last.
NOISE, NOISE_START = ["upload queued:", "processing upload:"], "resume upload ("


def text_of(c: str | Column) -> Column:
    return trimmed(F.coalesce(c, F.lit("")))


def or_else(c: str | Column, other: str | Column) -> Column:
    """The trimmed text, or something else where it is empty."""
    return F.coalesce(F.nullif(text_of(c), F.lit("")), other)


def feedback_kind(action: Column) -> Column:
    a, out = F.lower(text_of(action)), F.lit("feedback")
    for kind, names in FEEDBACK_KINDS.items():
        out = F.when(a.isin(names), kind).otherwise(out)
    return out


def feedback_message(action: Column, name: Column, job: Column) -> Column:
    kind = feedback_kind(action)
    out = F.concat(name, F.lit(": "), F.coalesce(F.nullif(action, F.lit("")), F.lit("update")), F.lit(" — "), job)
    for k, words in FEEDBACK_WORDS.items():
        out = F.when(kind == k, F.concat(name, F.lit(words), job)).otherwise(out)
    return out


def newest(df: DataFrame, source: str) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "key").limit(NEWEST[source])


def people_of(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that rows name; rows are as few as a source's newest, so they are sent to the candidates, not the other way round."""
    return candidates.select("candidate_id", "full_name").join(F.broadcast(rows.select("candidate_id").distinct()), "candidate_id", "left_semi")


def shown(df: DataFrame, source: int, id_: Column, kind: Column, message: Column, href: Column) -> DataFrame:
    return df.select(F.lit(source).alias("source"), id_.alias("id"), kind.alias("kind"), message.alias("message"), F.unix_timestamp("created_at").alias("at"), href.alias("href"))


def notifications(events: DataFrame, jobs: DataFrame, rankings: DataFrame, feedback: DataFrame, candidates: DataFrame, workspace: int, now: Column) -> DataFrame:
    """source, id, kind, message, at, href: at most MOST of a workspace, the newest of each source.

    Noise is taken out of the newest events, so fewer may be left. Ranking runs
    are the newest of all workspaces, of which those of the workspace are
    shown. Ties go to the smaller id. Names and sizes are looked up for the
    newest rows alone.
    """
    recent = F.col("created_at") >= now - F.expr(f"INTERVAL {HORIZON_DAYS} DAYS")
    labelled = jobs.select("job_id", or_else("title", F.col("job_id").cast("string")).alias("label"), F.col("workspace_id").alias("job_workspace"))
    job_link = lambda c: F.concat(F.lit("/jobs/"), F.col(c).cast("string"))

    logged = newest(events.where(F.col("workspace_id") == workspace).withColumn("key", F.col("event_id")), "event")
    kind, said = or_else("kind", F.lit("info")), or_else("message", F.lit("Update"))
    low = F.lower(said)
    noise = (kind == "upload") | low.startswith(NOISE_START)
    for words in NOISE:
        noise = noise | F.contains(low, F.lit(words))
    from_events = shown(logged.where(~noise), 0, F.concat(F.lit("event-"), F.col("key").cast("string")), kind, said, F.nullif(text_of("href"), F.lit("")))

    new = newest(jobs.where(recent & (F.col("workspace_id") == workspace)).withColumn("key", F.col("job_id")), "job")
    from_jobs = shown(new, 1, F.concat(F.lit("job-"), F.col("key").cast("string")), F.lit("job"), F.concat(F.lit("New job: "), or_else("title", F.col("key").cast("string"))), job_link("key"))

    runs = rankings.groupBy("job_id").agg(F.max("run_at").alias("created_at")).where("created_at is not null").withColumn("key", F.col("job_id"))
    runs = newest(runs, "ranking").join(labelled, "job_id").where(F.col("job_workspace") == workspace)
    first = F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), (-F.coalesce("similarity", F.lit(0.0))).alias("t"), "candidate_id"))["candidate_id"]
    sized = rankings.select("job_id", "candidate_id", "score", "similarity", F.col("run_at").alias("created_at")).join(runs, ["job_id", "created_at"]).groupBy("job_id", "created_at", "label").agg(F.count(F.lit(1)).alias("n"), first.alias("candidate_id"))
    named = sized.join(people_of(sized, candidates).select("candidate_id", text_of("full_name").alias("name")), "candidate_id", "left")
    top = F.when(F.col("name") != "", F.concat(F.lit(" — top match: "), F.col("name"))).otherwise("")
    said = F.concat(F.lit("Ranking updated for "), F.col("label"), F.lit(" ("), F.col("n").cast("string"), F.lit(" candidates scored)"), top)
    from_runs = shown(named, 2, F.concat(F.lit("rank-"), F.col("job_id").cast("string"), F.lit("-"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")), F.lit("ranking"), said, F.concat(F.lit("/jobs?job="), F.col("job_id").cast("string")))

    given = feedback.where(recent).join(labelled.where(F.col("job_workspace") == workspace), "job_id").withColumn("key", F.col("feedback_id"))
    given = newest(given, "feedback")
    given = given.join(people_of(given, candidates), "candidate_id", "left")
    said = feedback_message(F.col("action"), or_else("full_name", F.lit("A candidate")), F.col("label"))
    from_feedback = shown(given, 3, F.concat(F.lit("feedback-"), F.col("key").cast("string")), feedback_kind(F.col("action")), said, job_link("job_id"))

    every = from_events.unionByName(from_jobs).unionByName(from_runs).unionByName(from_feedback)
    return every.orderBy(F.desc("at"), "source", "id").limit(MOST)


def preview(subject: Column, body: Column) -> Column:
    """Subject and body in one line of at most LONGEST_PREVIEW signs."""
    line = F.concat_ws(": ", F.nullif(text_of(subject), F.lit("")), F.nullif(text_of(body), F.lit("")))
    cut = F.concat(F.substring(line, 1, LONGEST_PREVIEW - 1), F.lit("…"))
    return F.when(F.length(line) > LONGEST_PREVIEW, cut).when(line == "", "(empty message)").otherwise(line)


def scope_of(c: Column) -> Column:
    s = F.lower(text_of(c))
    return F.when(s.isin(SCOPES), s).otherwise("general")


def peers(messages: DataFrame, clients: DataFrame, candidates: DataFrame, users: DataFrame) -> DataFrame:
    """address, chat_scope, peer_name, peer_path of those that messages name.

    In its scope an address is the client or candidate that had it first, else
    the user's name, else the address. clients and candidates have id, email,
    created_at and names, an array of which the first that isn't empty counts.
    """
    asked = messages.select("address", "chat_scope").distinct()
    filled = lambda a: F.get(F.filter(a, lambda x: x != ""), F.lit(0))
    known = asked
    for scope, people in (("clients", clients), ("candidates", candidates)):
        wanted = asked.where(F.col("chat_scope") == scope)
        own = people.select(F.lower("email").alias("address"), "id", "created_at", F.coalesce(filled(F.transform("names", text_of)), F.lower("email")).alias("name")).join(wanted, "address")
        # What is unknown comes last, ties go to the smaller id.
        first = own.groupBy("address", "chat_scope").agg(F.min(F.struct(F.col("created_at").isNull(), "created_at", "id", "name")).alias(scope))
        known = known.join(first, ["address", "chat_scope"], "left")
    named = users.select(F.lower("email").alias("address"), "user_id", text_of("full_name").alias("name")).join(asked.select("address").distinct(), "address").groupBy("address").agg(F.min(F.struct("user_id", "name"))["name"].alias("user_name"))
    found = known.join(named, "address", "left")
    path = lambda scope: F.concat(F.lit(f"/{scope}/"), F.col(f"{scope}.id").cast("string"))
    return found.select("address", "chat_scope", F.coalesce("clients.name", "candidates.name", F.nullif("user_name", F.lit(""))).alias("found_name"), F.coalesce(path("clients"), path("candidates")).alias("peer_path"))


def inbox(activity: DataFrame, read: DataFrame, messages: DataFrame, clients: DataFrame, candidates: DataFrame, users: DataFrame, me: int) -> DataFrame:
    """A user's notifications and newest messages, of each direction at most MOST_MESSAGES, newest first.

    activity is what notifications gives, read has item_key, and messages has
    message_id, sender_id, recipient_id, subject, body, chat_scope,
    created_at, read_at, hidden_for_sender and hidden_for_recipient. A message
    whose other side is no user is left out.
    """
    marks = read.select(F.col("item_key").alias("id")).distinct().withColumn("seen", F.lit(True))
    none = F.lit(None).cast("string")
    alerts = activity.join(marks, "id", "left").select("id", "kind", "message", "at", F.coalesce("seen", F.lit(False)).alias("read"), F.lit(False).alias("direct"), none.alias("direction"), none.alias("peer_email"), none.alias("chat_scope"), none.alias("peer_name"), none.alias("peer_path"))
    ends = [("in", "recipient_id", "sender_id", "hidden_for_recipient"), ("out", "sender_id", "recipient_id", "hidden_for_sender")]
    sides = []
    for direction, mine, other, hidden in ends:
        own = messages.where((F.col(mine) == me) & ~F.col(hidden)).join(users.select(F.col("user_id").alias(other), F.col("email").alias("peer_email")), other)
        own = own.orderBy(F.desc("created_at"), "message_id").limit(MOST_MESSAGES)
        seen = F.col("read_at").isNotNull() if direction == "in" else F.lit(True)
        sides.append(own.select(F.lit(direction).alias("direction"), "message_id", "subject", "body", "created_at", "peer_email", seen.alias("read"), scope_of(F.col("chat_scope")).alias("chat_scope"), F.lower(text_of("peer_email")).alias("address")))
    both = sides[0].unionByName(sides[1])
    named = both.join(peers(both, clients, candidates, users), ["address", "chat_scope"], "left")
    name = F.when(F.col("address") == "", "Unknown").otherwise(F.coalesce("found_name", text_of("peer_email")))
    lead = F.when(F.col("direction") == "in", "New message from ").otherwise("Message to ")
    said = F.concat(lead, name, F.lit(" — "), preview(F.col("subject"), F.col("body")))
    direct = named.select(F.concat(F.lit("msg-"), F.col("message_id").cast("string")).alias("id"), F.lit("message").alias("kind"), said.alias("message"), F.unix_timestamp("created_at").alias("at"), "read", F.lit(True).alias("direct"), "direction", "peer_email", "chat_scope", name.alias("peer_name"), F.col("peer_path"))
    return alerts.unionByName(direct).orderBy(F.desc("at"), "direct", "id")


def in_tab(tab: str) -> Column:
    """Whether a row of the inbox is in a tab: all, alerts or candidates; an unknown tab has none."""
    name = (tab or "all").strip().lower()
    if name == "all":
        return F.lit(True)
    if name == "alerts":
        return ~F.col("direct")
    return F.col("direct") & (F.col("chat_scope") == "candidates") if name == "candidates" else F.lit(False)
