"""Skill strings as sets of tokens, their expansion and their overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A skill and what it stands for.
SYNONYMS = {
    "ci/cd pipelines": ["ci/cd", "ci", "cd", "pipelines", "cicd"],
    "ci/cd": ["ci/cd", "ci", "cd", "cicd"],
    "cicd": ["ci/cd", "ci", "cd", "cicd"],
    "message queues": ["message queues", "mq", "kafka", "rabbitmq"],
    "kafka": ["kafka", "message queues"],
    "rabbitmq": ["rabbitmq", "message queues"],
    "aws": ["aws", "ec2", "s3", "rds", "lambda", "cloudwatch", "iam", "vpc"],
    "amazon web services": ["aws", "ec2", "s3", "rds", "lambda"],
    "microservices": ["microservices", "distributed systems", "service architecture"],
    "distributed systems": ["distributed systems", "microservices"],
    "rest apis": ["rest apis", "rest", "api", "apis", "restful"],
}
# Skills that say little about a job.
GENERIC = [
    "communication",
    "communications",
    "teamwork",
    "leadership",
    "problem solving",
    "problem-solving",
    "reporting",
    "documentation",
    "ms office",
    "microsoft office",
    "excel",
    "powerpoint",
    "word",
    "presentation",
    "time management",
    "multitasking",
    "customer service",
    "interpersonal skills",
    "stakeholder management",
    "collaboration",
    "attention to detail",
]
# What is cut off a token's ends, and from which length one token may lie in another.
EDGES = " .:;!?'\"`~[]{}<>|"
LONG_ENOUGH = 4


def closure() -> dict[str, list[str]]:
    """What each known token expands to: its own group, or each group that holds it with the group's name."""
    known = set(SYNONYMS) | {x for group in SYNONYMS.values() for x in group}
    groups = {t: set(SYNONYMS[t]) if t in SYNONYMS else {x for k, g in SYNONYMS.items() if t in g for x in (k, *g)} for t in known}
    return {t: sorted(g | {t}) for t, g in sorted(groups.items())}


def token(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.trim(F.lower(c)), r"(?U)\s+", " "), F.lit(EDGES))


def parse_skills(c: Column) -> Column:
    """A delimited string as the array of its distinct tokens; null and empty give an empty array."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[()/\\]", ","), r"[,|\n;]")
    return F.array_distinct(F.filter(F.transform(parts, token), lambda x: x != ""))


def expand(tokens: Column) -> Column:
    """Tokens with their variants and synonyms."""
    table = F.create_map(*[x for k, v in closure().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def variants(t: Column) -> Column:
        known = F.coalesce(F.element_at(table, t), F.array(t))
        own = F.array(t, F.replace(t, F.lit("."), F.lit("")), F.when(t == "postgresql", "postgres").otherwise(t))
        return F.concat(own, known)

    return F.array_distinct(F.flatten(F.transform(tokens, variants)))


def expand_each(tokens: Column) -> Column:
    """The expansion of each token by itself."""
    return F.transform(tokens, lambda t: expand(F.array(t)))


def matched(wanted: Column, wanted_expanded: Column, have_expanded: Column) -> Column:
    """Those of wanted that a candidate's expanded skills hold: by a common expansion, or one inside the other where both are long enough.

    wanted_expanded is expand_each(wanted), made once for a job rather than for each pair.
    """

    def has(w: Column, i: Column) -> Column:
        inside = F.exists(have_expanded, lambda h: (F.length(h) >= LONG_ENOUGH) & (F.length(w) >= LONG_ENOUGH) & (F.contains(h, w) | F.contains(w, h)))
        return F.arrays_overlap(F.get(wanted_expanded, i), have_expanded) | inside

    return F.filter(wanted, has)


def overlap(wanted: Column, wanted_expanded: Column, have_expanded: Column) -> Column:
    """Share of wanted that is matched; nothing wanted gives 0."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(matched(wanted, wanted_expanded, have_expanded)) / F.size(wanted))


def weighted_coverage(wanted: Column, have: Column) -> Column:
    """Covered weight of wanted, where generic skills weigh a quarter."""
    weight = lambda t: F.when(t.isin(GENERIC), 0.25).otherwise(1.0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, t: acc + weight(t))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(total(F.array_intersect(wanted, have)) / total(wanted))


def covered(wanted: Column, have: Column) -> Column:
    """Share of wanted that is among have as it is; nothing wanted gives 0."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, have)) / F.size(wanted))


def critical(wanted: Column) -> Column:
    """Those of wanted that say something about a job."""
    return F.filter(wanted, lambda t: ~t.isin(GENERIC))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
