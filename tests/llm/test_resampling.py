"""Importance resampling against a plain version that puts every run of words together."""

import hashlib
import math
import random
import re
import zlib

from crestline.llm import resampling


def runs(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    source, wanted = [0] * 10_000, [0] * 10_000
    for _, text in docs:
        for b in runs(text)[1]:
            source[b] += 1
    for text in target:
        for b in runs(text)[1]:
            wanted[b] += 1
    s_all, t_all = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(source, wanted, strict=True)]
    rows = []
    for i, text in docs:
        n, found = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranked = [(*r, k if k <= 5 * len(eligible) // 100 else None) for k, r in enumerate(eligible, 1)]
    return sorted(ranked + [(*r, None) for r in rows if r[1] < 20], key=repr)


def test_resampling_is_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)] + ["ÄRGER", "Straße", "İ", "naïve", "x-y", "a\xa0b", "3.14", "😀", "\x00", "``", "It's"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for i in range(400)]
    docs += [(None, docs[8][1]), (None, None), (401, ""), (402, None), (403, "- . \n"), (7, docs[7][1]), (404, " ".join(rng.choices(vocabulary, k=90_000)))]
    target = [" ".join(rng.choices(vocabulary[:40], k=50)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, bucket string").repartition(5)
    wanted = spark.createDataFrame([(t, 3) for t in target], "text string, n int")
    for how in (resampling.Resampling(), resampling.Resampling(scan=2)):  # pieces of a text that end within runs
        got = [tuple(r) for r in resampling.resample(df, wanted, how).select("id", "n_words", "n_features", "weight", "score", "rank").collect()]
        assert sorted(got, key=repr) == brute(docs, target)
    none = resampling.resample(df.where("false"), wanted.where("false"))
    assert none.count() == 0
    alone = resampling.resample(df, wanted.where("false")).collect()
    assert len(alone) == len(docs) and sum(r["rank"] is not None for r in alone) == 5 * sum(runs(t)[0] >= 20 for _, t in docs) // 100


def test_ranks_over_many_ties(spark):
    """Copies with one id share their score; each is drawn for itself."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "repeat('same words again ', 10) as text")
    ranks = sorted(r["rank"] for r in resampling.resample(df, df.limit(0)).where("rank is not null").collect())
    assert ranks == list(range(1, 151))
