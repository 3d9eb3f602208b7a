"""Which candidates a workspace sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_candidates(candidates: DataFrame, links: list[DataFrame], jobs: DataFrame, hidden: DataFrame) -> DataFrame:
    """(workspace_id, candidate_id): own candidates and those linked with one of the workspace's jobs, without the hidden ones.

    links are relations with job_id and candidate_id: applications, rankings, shortlists.
    """
    pairs = candidates.where("workspace_id is not null").select("workspace_id", "candidate_id")
    ids = candidates.select("candidate_id")
    of_job = jobs.select("job_id", "workspace_id")
    for link in links:
        linked = link.select("job_id", "candidate_id").join(of_job, "job_id").select("workspace_id", "candidate_id")
        pairs = pairs.unionByName(linked.join(ids, "candidate_id", "left_semi").select("workspace_id", "candidate_id"))
    return pairs.distinct().join(hidden, ["workspace_id", "candidate_id"], "left_anti")
