"""A training corpus from documents: toxicity and quality filters, near-duplicate removal, packing.

Each stage gets what the one before kept. A filter returns its rows with all
columns as they came; only the last stage returns something else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import minhash, packing, quality, toxicity
from crestline.llm.common import table, written
from crestline.llm.membership import without
from crestline.llm.queries import vocabulary_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier flags.

    Each row is judged by its own text, whatever its id; a null or empty text,
    or one without words, gets the model's constant. Null and repeated ids stay
    as they are, but labels are learned only from ids that are not null. An
    empty table stays empty.
    """
    how = toxicity.Subwords()
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), how), how)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality, seen with their site's, is too low.

    Each row is judged by its own text and site, whatever its id; a null text
    counts as empty, null sources and languages are sites of their own. An
    empty table stays empty.
    """
    how = quality.Quality()
    model = quality.fit(docs, table(spark, sf_dir, "labels"), how)
    return quality.without_poor(docs, model, how, F.col("source"), F.col("lang"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the smallest id: five-word shingles, similarity 0.8 or more.

    Rows are told apart by a key that is written with them: ids may be null or
    repeated, and rows that share one are documents of their own. A null or
    empty text, or one without words, is no duplicate of anything. Of a group,
    a row with an id goes before one without, and of equal ids the first
    written stays. An empty table stays empty.
    """
    keyed = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    found = written(minhash.near_duplicates(keyed, minhash.MinHash(words=5, percent=80), "key", "row.text").select(F.col("id").alias("key"), "component_id"), "near_duplicates")
    named = found.join(keyed.select("key", F.col("row.doc_id").alias("doc_id")), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select("first.key")
    dropped = written(found.join(first, "key", "left_anti").select("key"), "dropped")
    return without(keyed, "key", dropped).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, a row for each piece.

    Every row is packed, also with a null or repeated id; a null or empty text
    is its end token alone. An empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary_path(), keep_ids=False).drop("ids").withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("near_duplicates", near_duplicates_out), ("packing", packed)]

#: Trained classifiers and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
