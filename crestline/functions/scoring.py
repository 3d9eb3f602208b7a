"""Scores of a candidate for a job, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: degrees in rising order, as the education score knows them.
DEGREES = {"intermediate": 1, "bachelors": 2, "masters": 3, "phd": 4}


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def exp_score(years: Column, least: Column) -> Column:
    """0.5 without a requirement, 0 for unknown years, else the share of the requirement that is met."""
    return F.when(least.isNull(), 0.5).when(years.isNull(), 0.0).when(least <= 0, 1.0).otherwise(F.least(F.lit(1.0), years / F.nullif(least, F.lit(0.0))))


def experience_band(years: Column, least: Column, most: Column) -> Column:
    """The step ladder: 1 inside the band, 0.9 above, 0.7 just below, 0.4 else or unknown."""
    low = F.coalesce(least, F.greatest(F.lit(0.0), most - 2))
    high = F.coalesce(most, least + 2)
    return F.when(years.isNull(), 0.4).when(least.isNull() & most.isNull(), 0.7).when((years >= low) & (years <= high), 1.0).when(years >= high, 0.9).when(years >= low - 1, 0.7).otherwise(0.4)


def degree_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in DEGREES.items():
        out = F.when(F.lower(F.trim(c)) == name, rank).otherwise(out)
    return out


def edu_score(degree: Column, required: Column) -> Column:
    """0.5 where nothing known is asked for, 0 for an unknown degree, else whether it is enough."""
    need, has = degree_rank(required), degree_rank(degree)
    return F.when(need.isNull(), 0.5).when(has.isNull(), 0.0).when(has >= need, 1.0).otherwise(0.0)


def weak_score(skill: Column, exp: Column, edu: Column) -> Column:
    return clamp(0.70 * skill + 0.20 * exp + 0.10 * edu)


def final_score(semantic: Column, skill: Column, exp: Column) -> Column:
    return clamp(0.5 * semantic + 0.3 * skill + 0.2 * exp)


def adjusted_match(raw: Column, semantic: Column, skill: Column, exp: Column, gamma: float = 2.0) -> Column:
    """The blend, never below the raw score, then lifted by 1 - (1 - x)^gamma."""
    blend = clamp(F.greatest(raw, 0.4 * raw + 0.3 * semantic + 0.2 * skill + 0.1 * exp))
    return clamp(1 - F.pow(1 - blend, F.lit(gamma))) if gamma > 1 else blend


def match_label(percent: Column) -> Column:
    return F.when(percent >= 70, "Strong").when(percent >= 45, "Medium").otherwise("Low")
