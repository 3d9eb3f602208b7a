"""Activity feeds, message threads, ingestion states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A training label and the actions that stand for it.
FEEDBACK_LABELS = {1.0: ["selected", "hired", "hired_interest", "hire", "yes"], 0.85: ["shortlisted", "shortlist"], 0.0: ["rejected", "reject", "not_a_fit", "no", "dismissed"]}


def feedback_status(action: Column) -> Column:
    """The status that feedback gives a candidate: rejections by any name, the core three as they are, else the action's letters, digits, - and _, at most 64."""
    a = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    a = F.when(a.isin("not_a_fit", "not a fit", "reject"), "rejected").otherwise(a)
    plain = F.btrim(F.regexp_replace(a, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.when(a == "", "new").when(plain == "", "reviewed").otherwise(F.substring(plain, 1, 64))


def threads(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, those from the user, the last turn and who spoke then."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("incoming"), F.max("turn").alias("last_turn"), F.max(F.struct("turn", "role"))["role"].alias("last_role"))


def ingestion_rollup(queue: DataFrame, now: Column, stale_minutes: int = 20) -> DataFrame:
    """States per batch; what has been processing for too long has failed."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") <= now - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    s = F.when(stale, "failed").otherwise(F.col("status"))
    states = ["queued", "processing", "done", "failed"]
    return queue.withColumn("s", s).groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("s") == x).alias(x) for x in states])


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last event of each pair as a training label, spaces in its action being underscores; actions without a label drop the pair."""
    last = feedback.groupBy("job_id", "candidate_id").agg(F.max(F.struct("created_at", "action")).alias("x")).select("job_id", "candidate_id", F.replace(F.lower(F.trim("x.action")), F.lit(" "), F.lit("_")).alias("action"))
    label = F.lit(None).cast("double")
    for value, actions in FEEDBACK_LABELS.items():
        label = F.when(F.col("action").isin(actions), value).otherwise(label)
    return last.withColumn("label", label).where("label is not null")


def interval_years(ranges: DataFrame, cap: int = 40) -> DataFrame:
    """Years that each key's ranges cover together, overlaps once; ranges have key, start and end in years."""
    from pyspark.sql import Window as W

    rows = ranges.where("end >= start")
    before = F.max("end").over(W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    return rows.withColumn("covered", covered).groupBy("key").agg(F.least(F.lit(cap), F.sum("covered")).alias("years"))
