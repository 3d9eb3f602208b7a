"""Applicant status: aliases, time to live, buckets and priorities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ALIASES = {"interview": "interviewing", "interviewed": "interviewing", "declined": "rejected", "reviewed": "screened"}
PRIORITY = {"hired": 7, "rejected": 6, "declined": 6, "interviewing": 5, "interview": 5, "interviewed": 5, "shortlisted": 4, "selected": 4, "screened": 3, "reviewed": 3, "new": 1}
BUCKETS = {"total": None, "new": ["new"], "screened": ["screened"], "shortlisted": ["shortlisted", "selected"], "interviewing": ["interviewing"], "hired": ["hired"], "rejected": ["rejected"]}
NEW_DAYS = 7


def normalised(status: Column) -> Column:
    """Lower case, trimmed, aliases replaced; null is new."""
    s = F.lower(F.trim(F.coalesce(status, F.lit("new"))))
    out = s
    for alias, name in ALIASES.items():
        out = F.when(s == alias, name).otherwise(out)
    return out


def effective(status: Column, created_at: Column, now: Column) -> Column:
    """A status of new counts as screened once its candidate is seven days old."""
    s = normalised(status)
    return F.when((s == "new") & (created_at <= now - F.expr(f"INTERVAL {NEW_DAYS} DAYS")), "screened").otherwise(s)


def priority(status: Column) -> Column:
    s = F.lower(F.trim(status))
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(s == name, value).otherwise(out)
    return out


def funnel_counts(effective_status: Column) -> list[Column]:
    """The funnel's columns, one conditional count each; a status outside all buckets counts in the total alone."""
    return [(F.count(F.lit(1)) if names is None else F.count_if(effective_status.isin(names))).alias(bucket) for bucket, names in BUCKETS.items()]
