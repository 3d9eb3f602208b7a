"""Date texts of a profile's rows: months counted from year 0, ranges, durations, and rows of schools among jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by their first letters, what stands for now, and the patterns of dates and durations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NOW = r"(?i)present|current"
NOW_WORDS = ["present", "current"]
BLANKS = " \t\n\x0b\f\r"
MONTH_YEAR = r"([A-Za-z]{3,9})[.\s,]+(\d{4})"
YEAR = r"\b((?:19|20)\d{2})\b"
DASH = r"[–—-]"
YEARS_MONTHS = r"(?i)(\d+)\s+yr[s]?\s*(\d+)?\s*mo[s]?"
YEARS = r"(?i)(\d+)\s+yr[s]?\b"
NO_DURATION_WORDS = ["don't want to see", "your feedback will help", "same ad too often"]
NO_DURATION = r"(?i)\d+\s*years?\s+related\b|don't want to see|your feedback will help|same ad too often"
# What only a school's row says, degrees, places of study, and a degree or a student as a role.
STUDY_WORDS = ["field", "activities", "grade"]
STUDY = r"\bfield\s+of\s+study\b|\bactivities\s+and\s+societies\b|\bgrade\b"
DEGREE = r"(?i)\b(bachelor|bachelors|master|masters|mba|phd|ph\.?\s*d\.?|doctorate|doctoral|m\.?phil|b\.?s\.?\b|m\.?s\.?\b|m\.?sc\.?\b|b\.?e\.?\b|b\.?tech|m\.?tech|b\.?a\.?\b|b\.?sc\.?\b|m\.?eng|associate'?s?\s+degree|undergraduate|graduate\s+degree|diploma\s+in)\b"
SCHOOL_WORDS = ["uni", "college", "polytechnic", "école", "escuela", "institute", "academy", "school"]
SCHOOL = r"(?i)\b(university|college|polytechnic|école|escuela|uni\s+de\b|institute\s+of\s+technology|academy)\b|\b(high\s+school|secondary\s+school)\b"
DEGREE_ROLE = r"(?i)\b(bachelor|master|doctor|mba|associate)'?s?\s+degree'?s?\b"
STUDENT = r"(?i)\bstudent\b"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then of c, which is computed once however often then names it; Spark works out a repeated expression anew in every branch."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def _has(c: Column, *words: str) -> Column:
    """Whether one of the words is in c: what a pattern can't match without, looked for before it."""
    return reduce(Column.__or__, [c.contains(w) for w in words])


def month_index(text: Column, now: Column) -> Column:
    """Twelve times the year and the month from 0, of the first month and year, else of the first year alone; null without either."""

    def index(t: Column) -> Column:
        year = F.nullif(F.regexp_extract(t, YEAR, 1), F.lit("")).cast("int") * 12
        place = lambda found: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(found, 1, 3)))
        dated = lambda found: _once(place(found), lambda month: F.when(month > 0, F.right(found, F.lit(4)).cast("int") * 12 + month - 1).otherwise(year))
        today = F.year(now) * 12 + F.month(now) - 1
        return F.when(_once(F.lower(t), lambda low: _has(low, *NOW_WORDS)), today).otherwise(_once(F.regexp_extract(t, MONTH_YEAR, 0), dated)).cast("int")

    return _once(_empty(text), index)


def _range(parts: Column, now: Column, told: Callable[[Column], Column]) -> Column:
    """told of start and end, from the first two parts; null if either is missing or the end comes first."""
    both = F.struct(month_index(F.get(parts, F.lit(0)), now).alias("start"), month_index(F.get(parts, F.lit(1)), now).alias("end"))
    return F.when(F.size(parts) >= 2, _once(both, lambda x: F.when(x["end"] >= x["start"], told(x))))


def month_range(dates: Column, now: Column) -> Column:
    """(start, end) in months of "from - to"; null if either is missing or the end comes first."""
    parts = F.filter(F.split(_empty(dates), DASH), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return _once(parts, lambda p: _range(p, now, lambda both: both))


def months(dates: Column, now: Column) -> Column:
    """Months from the range, else from "x yrs y mos", else 0."""

    def told(t: Column, low: Column) -> Column:
        number = lambda pattern, group: F.coalesce(F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).cast("int"), F.lit(0))
        spelled = F.when(t.rlike(YEARS_MONTHS), number(YEARS_MONTHS, 1) * 12 + number(YEARS_MONTHS, 2)).otherwise(number(YEARS, 1) * 12)
        ranged = _once(F.split(t, DASH), lambda parts: _range(parts, now, lambda both: both["end"] - both["start"]))
        return F.when(_has(low, "related", *NO_DURATION_WORDS) & low.rlike(NO_DURATION), 0).otherwise(F.coalesce(ranged, F.when(_has(low, "yr"), spelled), F.lit(0)))

    return _once(_empty(dates), lambda t: _once(F.lower(t), lambda low: told(t, low)))


def dates_key(dates: Column) -> Column:
    """A date text whatever its dashes, spaces and capitals."""
    return F.lower(F.trim(F.regexp_replace(F.translate(_empty(dates), "–—", "--"), r"\s+", " ")))


def is_study(role: Column, company: Column, description: Column) -> Column:
    """Whether a row among jobs reads as a school's."""
    said = F.concat_ws("\n", _trim(_empty(role)), _trim(_empty(company)), _trim(_empty(description)))

    def read(blob: Column) -> Column:
        low = F.lower(_empty(role))
        degree, student = _has(low, "degree") & _empty(role).rlike(DEGREE_ROLE), _has(low, "student") & _empty(role).rlike(STUDENT)
        at_school = _has(blob, *SCHOOL_WORDS) & blob.rlike(SCHOOL)
        return (_has(blob, *STUDY_WORDS) & blob.rlike(STUDY)) | degree | (at_school & (student | blob.rlike(DEGREE)))

    return _once(F.lower(said), read)
