"""The audit of filters against a count of each document in each order."""

import random
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from crestline.llm import filter_audit


def fails(text, first):
    words = text.encode().split()
    upper = sum("A" <= c <= "Z" for c in text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), any(c in "#$%&*|" for c in text), not first]


def brute(docs, labels):
    """Rows by part, order and step, each document followed through each order."""
    out = {}
    texts = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            texts[text or ""] = min(texts.get(text or "", doc_id), doc_id)
    of_part = {}
    for doc_id, text, part in docs:
        of_part.setdefault(part or "", []).append((fails(text or "", doc_id is None or texts[text or ""] == doc_id), *labels.get(doc_id, (0, 0))))
    for part, rows in of_part.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [r for r in left if r[0][k]]
                left = [r for r in left if not r[0][k]]
                shapley[letter] += len(gone)
                failing = [r for r in rows if r[0][k]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[0]) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_audit_is_brute_force(spark):
    rng = random.Random(4)
    # Counts of words, shares of capitals and of distinct words lie on both sides of each limit, and on it.
    pieces = [*(f"w{i}" for i in range(130)), "AB", "A", "#", "ünïcode", "😀", "a\xa0b", "x\x0by", "\x1c"]
    bases = [" ".join(rng.sample(pieces, k=rng.choice([0, 5, 99, 100, 101, 130]))) for _ in range(40)]
    bases += [" ".join([f"d{i}" for i in range(80)] + ["d0"] * 20), " ".join([f"d{i}" for i in range(79)] + ["d0"] * 21), "A" + "a" * 9, "AA" + "a" * 9, "", "\t \n", "x" * 60_000]
    docs = [(i, rng.choice(bases), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(None, bases[0], "en"), (None, bases[0], "en"), (5, docs[5][1], "en"), (900, None, "fr"), (901, "", "fr")]
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)}
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    known = [(i, q, t, "x") for i, (q, t) in labels.items()] + [(None, 1, 1, "x"), (4, 0, None, "x"), (5000, 1, 1, "x")]
    got = filter_audit.audit(df, spark.createDataFrame(known, "doc_id long, quality int, toxic int, part string")).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in got} == brute(docs, labels)
    assert len(got) == 4 * 600
    assert filter_audit.audit(df.where("false"), spark.createDataFrame(known, "doc_id long, quality int, toxic int, part string")).count() == 0


def test_a_hot_text_fails_but_once_passes(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(None).cast("string").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    first = {r["filter_order"]: r for r in filter_audit.audit(df, labels).where("step = 1").collect()}
    assert first["EABCD"]["removed"] == 666 and first["EABCD"]["kept"] == 1334 and first["ABCDE"]["removed"] == 2000


def test_survivors_of_each_subset():
    counts = np.random.default_rng(1).integers(0, 9, 32)
    got = filter_audit.survivors(counts)
    assert got.tolist() == [sum(int(n) for m, n in enumerate(counts) if not m & s) for s in range(32)]
