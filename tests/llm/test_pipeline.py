import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_rows_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("id", F.lit("x")).withColumn("y", F.lit(1))
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars", "id", "y")
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
            assert 0 < docs.count() <= before.count()
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null").count() == 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert docs.where("doc_id is not null").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_rows_are_judged_one_by_one(spark):
    """A null id and one id of many rows: neither a poor row nor another text with that id takes a row along."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned_from = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns).withColumn("n_chars", F.lit(-1))
    for own_id in (None, -5):
        out = corpus_pipeline.poor_out(spark, learned_from.unionByName(docs.withColumn("doc_id", F.lit(own_id).cast("long"))), SF)
        hot = out.where(F.col("doc_id").eqNullSafe(F.lit(own_id).cast("long"))).count()
        assert 0.5 * docs.count() < hot < docs.count()


def test_near_duplicates_do_not_ask_for_ids(spark):
    long_ = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcd"]
    rows = [(None, long_[0]), (None, long_[0]), (None, long_[1]), (7, long_[2]), (7, long_[3]), (7, long_[3]), (3, long_[3] + " end"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).repartition(3)
    out = corpus_pipeline.near_duplicates_out(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in out.collect())
    assert got == sorted([(0, long_[0]), (0, long_[1]), (7, long_[2]), (3, long_[3] + " end"), (8, ""), (8, "")])
