"""Labelled rows for a classifier: a bounded sample whose ids alone are sent to the documents, so no text is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import held_out, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(id, text, y, row) of at most `most` labelled documents that are not held out, and the share of label 1 among all such labels.

    At most half come from either label, by the smallest hashes of the ids.
    A repeated id has label 1 if any of its labels is; each of its different
    texts is a row of its own, told apart by row, the text's hash, and counts
    toward the bound. Null ids and labels are left out. `most` bounds the
    sample, and the ids and rows that are broadcast; texts come whole.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64("id", F.lit(11))
    half = [known.where(F.col("y") == v).orderBy(order, "id").limit(most // 2) for v in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(half[0].unionByName(half[1])), "id").groupBy("id", "y", F.xxhash64("text").alias("row")).agg(F.first("text").alias("text"))
    found = written(found, "labelled")
    keys = [found.where(F.col("y") == v).select("id", "y", "row").orderBy(order, "id", "row").limit(most // 2) for v in (0, 1)]
    return found.join(F.broadcast(keys[0].unionByName(keys[1])), ["id", "y", "row"]).select("id", "text", "y", "row"), float(share or 0.0)
