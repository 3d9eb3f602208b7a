"""Uploaded texts as candidates: one for each content, however often it comes, and shown again to who hid it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = "external_id string, full_name string, title string, contact_email string, status string, workspace_id int, n_uploads long"


def identified(uploads: DataFrame) -> DataFrame:
    """uploads with external_id, from the content alone. An upload without a content is none."""
    return uploads.where(F.col("content").isNotNull()).withColumn("external_id", F.concat(F.lit("u_"), F.substring(F.sha2("content", 256), 1, 14)))


def folded(uploads: DataFrame) -> DataFrame:
    """The candidates that a table of uploads makes: the last name and title, the last address that isn't empty, the first workspace.

    uploads has upload_id, at, content, full_name, title, contact_email and
    workspace_id; of uploads at the same time the larger upload_id is the
    later. Contents don't leave the tasks, and a content that comes a million
    times is aggregated before the shuffle.
    """
    said = F.when(F.trim(F.coalesce("contact_email", F.lit(""))) != "", F.struct("at", "upload_id", "contact_email"))
    owned = F.when(F.col("workspace_id").isNotNull(), F.struct("at", "upload_id", "workspace_id"))
    last = identified(uploads).groupBy("external_id").agg(
        F.max(F.struct("at", "upload_id", "full_name", "title")).alias("last"), F.max(said).alias("said"), F.min(owned).alias("owned"), F.count(F.lit(1)).alias("n_uploads")
    )
    return last.select(
        "external_id", "last.full_name", "last.title", F.coalesce("said.contact_email", F.lit("")).alias("contact_email"), F.lit("new").alias("status"), F.col("owned.workspace_id").cast("int").alias("workspace_id"), "n_uploads"
    )


def upserted(candidates: DataFrame, uploads: DataFrame) -> DataFrame:
    """candidates after uploads that came later than all they were made of.

    A known candidate takes name, title and a given address anew, but keeps
    its status and its workspace; one without a workspace goes to the first
    that uploads it.
    """
    new, columns = folded(uploads), [c for c in candidates.columns if c != "external_id"]
    both = candidates.alias("old").join(new.alias("new"), "external_id", "full")
    here = F.col("new.n_uploads").isNotNull()
    value = {
        "full_name": F.when(here, F.col("new.full_name")).otherwise(F.col("old.full_name")),
        "title": F.when(here, F.col("new.title")).otherwise(F.col("old.title")),
        "contact_email": F.coalesce(F.nullif(F.col("new.contact_email"), F.lit("")), F.col("old.contact_email"), F.lit("")),
        "status": F.coalesce(F.nullif(F.trim("old.status"), F.lit("")), F.lit("new")),
        "workspace_id": F.coalesce("old.workspace_id", "new.workspace_id"),
        "n_uploads": F.coalesce("old.n_uploads", F.lit(0)) + F.coalesce("new.n_uploads", F.lit(0)),
    }
    return both.select("external_id", *[value[c].alias(c) for c in columns])


def still_hidden(hidden: DataFrame, uploads: DataFrame) -> DataFrame:
    """hidden (workspace_id, external_id, at) but what the same workspace uploaded again at that time or later."""
    again = identified(uploads).where("workspace_id is not null").groupBy("workspace_id", "external_id").agg(F.max("at").alias("_again"))
    return hidden.join(again, ["workspace_id", "external_id"], "left").where(F.col("_again").isNull() | (F.col("_again") < F.col("at"))).drop("_again")
