"""Removal of repeated passages against a plain version that keeps every window of words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crestline.llm import passages


def brute(docs, k=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, words in split:
        if i is not None:
            for at in range(len(words) - k + 1):
                window = tuple(words[at : at + k])
                first[window] = min(first.get(window, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for at in range(len(words) - k + 1):
            if i is not None and first[tuple(words[at : at + k])] < i:
                gone[at : at + k] = [True] * k
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["a\xa0b", "é", "\x1c", "😀😀", "x\x00y", "ab", "a", "b", " "]
    long = [rng.choices(words, k=rng.choice([12, 13, 14, 26, 150, 400])) for _ in range(25)]
    docs = []
    for i in rng.sample(range(10 * n), n):
        found = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(long)
            lo = rng.randrange(len(part))
            found += rng.choices(words, k=rng.choice([0, 0, 1, 5, 30])) + part[lo : lo + rng.choice([5, 12, 13, 14, 20, 300])]
        if rng.random() < 0.2:
            found = rng.choice(long) * 2
        docs.append((i, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(found) + rng.choice(["", " ", "\n"])))
    return docs


@pytest.mark.parametrize("how", [passages.Passages(), passages.Passages(range_chars=2000, automaton_words=40, fan_out=4), passages.Passages(range_chars=500, cut=10, fan_out=16)])
def test_passages_are_brute_force(spark, how):
    rng = random.Random(13)
    docs = corpus(rng, 250)
    docs += [(None, docs[0][1]), (None, None), (99_991, None), (99_992, ""), (99_993, " \n"), docs[3], (docs[4][0], docs[5][1]), (-7, docs[6][1]), (1 << 62, docs[7][1])]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, shard int, owner string, guest int").repartition(5)
    got = sorted((tuple(r) for r in passages.without_passages(df, how).collect()), key=repr)
    assert got == brute(docs)


def test_small_windows_and_common_lines(spark):
    """Blocks that occur everywhere, in windows of one to three words."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 9)))) for i in range(60)] + [(100 + i, f"{i} x y z {i}") for i in range(60)]
    for k in (1, 2, 3):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert sorted((tuple(r) for r in passages.without_passages(df, passages.Passages(words=k)).collect()), key=repr) == brute(docs, k)


def test_hot_copies_a_long_text_and_no_documents(spark):
    rng = random.Random(8)
    long = " ".join(f"l{rng.randrange(5000)}" for _ in range(60_000))
    copy = " ".join(f"c{i}" for i in range(40))
    df = spark.range(900).select((F.col("id") + 10).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(copy)).otherwise(F.concat(F.lit("own text "), "id", F.lit(" among twelve words of which no others have a b c"))).alias("text"))
    df = df.unionByName(spark.createDataFrame([(1, long), (5000, long[3000:200_000])], "doc_id long, text string")).repartition(6)
    got = {r["id"]: (r["n_words"], r["n_removed"]) for r in passages.without_passages(df, passages.Passages(range_chars=20_000)).collect()}
    assert got[10] == (40, 0) and all(got[10 + i] == (40, 40) for i in range(3, 900, 3)) and all(got[10 + i][1] == 0 for i in range(900) if i % 3)
    n = len(long[3000:200_000].split())
    assert got[1] == (60_000, 0) and n - 2 <= got[5000][1] <= n
    assert passages.without_passages(df.where("false")).count() == 0


def test_runs_of_bits():
    how = passages.Passages()
    assert list(passages._runs(0b1011, 0, how)) == [(0, 1), (3, 3)]
    assert list(passages._runs(1 << 62, 1 | 1 << 62, how)) == [(62, 63), (125, 125)]
    assert list(passages._runs(0, 0, how)) == []


def test_documents_without_a_repeat(spark):
    df = spark.range(300).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), x -> concat(id, '-', x))) as text").repartition(4)
    assert {(r["n_words"], r["n_removed"]) for r in passages.without_passages(df, passages.Passages(range_chars=3000)).collect()} == {(40, 0)}
