"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import oracles
from crestline.llm.common import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.embeddings import Cells, near_duplicate_vectors

    out = near_duplicate_vectors(table(spark, sf_dir, "embeddings"), Cells(least=0.95))
    return out.withColumnRenamed("id", "vec_id")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.minhash import MinHash, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), MinHash(words=3, percent=85))
    return out.withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.warc import round_trip

    out = round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.toxicity import Subwords, fit, score_toxicity

    docs, how = table(spark, sf_dir, "documents"), Subwords()
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels"), how), how).withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.quality import Quality, fit, score_quality

    docs, how = table(spark, sf_dir, "documents"), Quality()
    model = fit(docs, table(spark, sf_dir, "labels"), how)
    return score_quality(docs, model, how, F.col("source"), F.col("lang")).withColumnRenamed("id", "doc_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.resampling import Resampling, resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Resampling())
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.passages import Passages, without_passages

    out = without_passages(table(spark, sf_dir, "documents"), Passages(words=13))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
