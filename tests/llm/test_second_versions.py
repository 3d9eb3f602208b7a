"""Packing choices, toxicity scores, site posteriors and learned rows against plain versions of them."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from crestline.llm import learning, minhash, packing, quality, toxicity


def test_a_piece_goes_where_the_squares_are_fewest():
    rng = random.Random(1)
    packer = packing.SquaresPacker(40, most_open=10**9)
    for _ in range(400):
        n = rng.randint(1, 39)

        def squares(h, n=n):
            counts = [int(c) for c in packer.level]
            if h:
                counts[h] -= 1
            if h + n < 40:
                counts[h + n] += 1
            return sum(c * c for c in counts[1:])

        options = [0] + [h for h in range(1, 40 - n + 1) if packer.level[h]]
        least = min(map(squares, options))
        assert packer.choose(n) == max(h for h in options if squares(h) == least)
        packer.put((0, 0, bytes(4 * n)))


def test_toxicity_scores_are_the_models(spark):
    how = toxicity.Subwords(buckets=512)
    model = np.random.default_rng(2).normal(0, 2, 513)

    def score(text):
        total, n = 0.0, 0
        for word in set(re.findall(r"[^\W_]+", (text or "").lower())):
            marked = f"<{word}>"
            grams = {marked} | {marked[i:j] for i in range(len(marked)) for j in range(i + 3, min(i + 5, len(marked)) + 1)}
            total += sum(model[zlib.crc32(g.encode()) % 512] for g in grams)
            n += len(grams)
        return 1 / (1 + math.exp(-(model[-1] + (total / n if n else 0.0))))

    texts = ["Some words, some WORDS again", "ünïcode_name x", None, "", "! ?", "word " * 20_000, " ".join(f"w{i}" for i in range(5000))]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(0, "another text", "y", 0.1)], "doc_id long, text string, words string, score double")
    got = sorted((r["id"], r["score"], r["predicted"]) for r in toxicity.score_toxicity(docs, model, how).collect())
    want = sorted((i, score(t)) for i, t in [*enumerate(texts), (0, "another text")])
    assert [g[:2] for g in got] == [(i, pytest.approx(s, abs=1e-6)) for i, s in want]
    assert all(p == int(s >= 0.5) for _, s, p in got)
    # A tie at one half is flagged.
    tied = toxicity.score_toxicity(docs.where("text is null"), np.zeros(513), how).first()
    assert (tied["score"], tied["predicted"]) == (0.5, 1)


def test_site_posteriors_by_hand(spark):
    rng = random.Random(3)
    seen = [(i, rng.choice(["a", "b", "b", "b"]), rng.choice(["x", "y"]), round(rng.uniform(0.05, 0.95), 3)) for i in range(80)] + [(99, "c", "z", 0.4)]
    how = quality.Quality()
    frame = spark.createDataFrame(seen, "id long, host string, path string, p double")
    sites = quality.sites_of(frame, how)
    got = {r["id"]: (r["p_host"], r["p_path"], r["score"]) for r in sites.score(frame).collect()}
    overall = sum(p for *_, p in seen) / len(seen)
    assert sites.overall == pytest.approx(overall)

    def strength(groups):
        groups = [(n, s, m) for n, s, m in groups if n > 1]
        spread = sum(n * (s / n - m) ** 2 for n, s, m in groups) - sum(m * (1 - m) for _, _, m in groups)
        between = spread / sum(n * m * (1 - m) for n, _, m in groups)
        return how.strongest if between <= 1 / (how.strongest + 1) else max(how.weakest, 1 / between - 1)

    def sums(key):
        out = {}
        for r in seen:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r[3]
        return out

    hosts, paths = sums(lambda r: r[1]), sums(lambda r: r[1:3])
    k_host = strength([(n, s, overall) for n, s in hosts.values()])
    k_path = strength([(n, s, (hosts[h][1] + k_host * overall) / (hosts[h][0] + k_host)) for (h, _), (n, s) in paths.items()])
    assert (sites.k_host, sites.k_path) == (pytest.approx(k_host), pytest.approx(k_path))
    logit = lambda x: math.log(x / (1 - x))
    for i, host, path, p in seen:
        on_host = (hosts[host][1] - p + k_host * overall) / (hosts[host][0] - 1 + k_host)
        on_path = (paths[host, path][1] - p + k_path * on_host) / (paths[host, path][0] - 1 + k_path)
        score = 1 / (1 + math.exp(-(logit(p) + logit(on_path) - logit(overall))))
        assert got[i] == pytest.approx((on_host, on_path, score), abs=1e-9)


def test_learned_rows_are_bounded_and_whole(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(300)] + [(1, f"other {i}", "x") for i in range(50)] + [(2, long, "x"), (2, long, "x"), (None, "none", "x")], "doc_id long, text string, row string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    rows, share = learning.labelled_sample(docs, labels, "toxic", 10_000)
    got = sorted((r["id"], r["text"]) for r in rows.collect())
    want = {(i, f"text {i}") for i in range(300)} | {(1, f"other {i}") for i in range(50)} | {(2, long)}
    assert got == sorted(x for x in want if x[0] not in held) and 0.4 < share < 0.6
    few, _ = learning.labelled_sample(docs, labels, "toxic", 40)
    ys = [r["y"] for r in few.collect()]
    assert 0 < ys.count(0) <= 20 and 0 < ys.count(1) <= 20
    assert learning.labelled_sample(docs, labels.where("false"), "toxic", 40)[0].count() == 0


def test_clusters_of_long_documents_are_small_blocks(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(6):
            words[rng.randrange(600)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [set(zip(*[t.split()[k:] for k in range(3)], strict=False)) for _, t in rows]
    up = list(range(24))
    for _ in range(24):
        for i in range(24):
            for j in range(24):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    for how in (minhash.MinHash(), minhash.MinHash(block_shingles=1500)):
        assert {r["id"]: r["component_id"] for r in minhash.near_duplicates(df, how).collect()} == dict(enumerate(up))
