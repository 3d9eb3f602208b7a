"""Search by TF-IDF against all pairs in plain Python, and the ranking of a pool."""

import math
import random
import re
from collections import Counter

import pytest

from crestline.operators import lexical

IDS = "id long, text string"


def terms(text):
    w = [x for x in (text or "").lower().split() if len(x) > 1 and x not in lexical.STOP_WORDS]
    return Counter(w + [" ".join(p) for p in zip(w, w[1:])])


def brute(queries, docs, k, least, share, most):
    sides = {(0, i): terms(t) for i, t in queries} | {(1, i): terms(t) for i, t in docs}
    df, total = Counter(), Counter()
    for c in sides.values():
        df.update(c.keys())
        total.update(c)
    known = sorted((t for t in df if least <= df[t] <= share * len(sides)), key=lambda t: (-total[t], t))[:most]
    idf = {t: math.log((1 + len(sides)) / (1 + df[t])) + 1 for t in known}
    vec = {s: {t: n * idf[t] for t, n in c.items() if t in idf} for s, c in sides.items()}
    norm = {s: math.sqrt(sum(x * x for x in v.values())) for s, v in vec.items()}
    out = []
    for q, _ in queries:
        near = []
        for d, _ in docs:
            a, b = vec[0, q], vec[1, d]
            if a.keys() & b.keys():
                near.append((-round(sum(a[t] * b[t] for t in a.keys() & b.keys()) / norm[0, q] / norm[1, d], 4), d))
        out += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(near)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    """Words of falling frequency, one in nearly every text, copies, a long text, empty ones and a null."""
    r = random.Random(5)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 60}"
    docs = [(i, " ".join(["every", *(word() for _ in range(r.choice([1, 4, 30])))])) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(9)] + [(300, ""), (301, None), (302, "the of"), (303, " ".join(word() for _ in range(4000)))]
    return [(i, " ".join(["every", *(word() for _ in range(6))])) for i in range(12)] + [(50, docs[3][1]), (51, None), (52, "nothing alike")], docs


@pytest.mark.parametrize("first", [0, 25, 100_000])
@pytest.mark.parametrize("kept", [(2, 0.95, None), (1, 1.0, 40)])
def test_pruned_search_equals_all_pairs(spark, corpus, first, kept):
    """first = 0 gives no bound from below, so all terms bring documents up; the rows are the same."""
    queries, docs = corpus
    got = lexical.tfidf_top_k(spark.createDataFrame(queries, IDS), spark.createDataFrame(docs, IDS), 5, *kept, first=first)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect())
    want = brute(queries, docs, 5, *kept)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1.5e-4)
    close = lambda q, s: sum(w[0] == q and abs(w[3] - s) < 3e-4 for w in want) > 1
    assert all(g[2] == w[2] or close(g[0], g[3]) for g, w in zip(got, want, strict=True))


def test_frequent_terms_bring_nothing_up(spark, corpus, monkeypatch):
    """A word of nearly all texts only completes scores: far fewer pairs come up than queries times documents."""
    r = random.Random(6)
    docs = [(i, f"every thing w{i % 40} " + " ".join(f"x{r.randrange(30)}" for _ in range(8))) for i in range(400)]
    queries = [(i, f"every thing w{i}") for i in range(10)]
    pairs, plain = [], lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df, name: (lambda out: pairs.append(out.count()) or out if name == "found" else out)(plain(df, name)))
    got = lexical.tfidf_top_k(spark.createDataFrame(queries, IDS), spark.createDataFrame(docs, IDS), 5, 1, 1.0).collect()
    assert sorted((g["query_id"], g["rank"]) for g in got) == [(q, k) for q in range(10) for k in range(1, 6)]
    assert pairs[0] < 10 * 400 / 8


def test_empty_sides(spark, corpus):
    some, none = spark.createDataFrame(corpus[0], IDS), spark.createDataFrame([], IDS)
    assert lexical.tfidf_top_k(some, none, 3).count() == lexical.tfidf_top_k(none, some, 3).count() == 0


def test_ranked_pool(spark):
    """Who shares no term may be in the pool with cosine 0; rows without text and, with a limit, old ones are not."""
    jobs = spark.createDataFrame([(1, 2.0, None, "python, sql", "python sql pipelines"), (2, 0.0, None, "x", "x")], "job_id long, min_experience double, education_required string, skills string, text string")
    people = [(1, 3.0, None, "python, sql", 5, "python sql pipelines"), (2, 3.0, None, "", 4, "green tea"), (3, 3.0, None, "python", 3, "sql python"), (4, 9.0, None, "python, sql", 9, "  "), (5, 9.0, None, "python, sql", 1, "python sql pipelines")]
    candidates = spark.createDataFrame(people, "candidate_id long, years double, degree string, skills string, created_at int, text string")
    every = lexical.rank_pool(jobs, 1, candidates, 10, 10).collect()
    assert [(r["place"], r["candidate_id"]) for r in every] == [(1, 1), (2, 5), (3, 3), (4, 2)]
    assert every[0]["cosine"] == every[0]["score"] == 1.0 and every[3]["cosine"] == 0.0
    assert [r["candidate_id"] for r in lexical.rank_pool(jobs, 1, candidates, 2, 10, pool=3).collect()] == [1, 3]
    assert [r["candidate_id"] for r in lexical.rank_pool(jobs, 1, candidates, 10, 1).collect()] == [1]


def test_texts_meet_their_weights_without_a_sort(spark, corpus, monkeypatch):
    """The first join of all, of each text's terms with what is known of them, hashes the terms' weights."""
    plans, write = {}, lexical.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return write(df, name)

    monkeypatch.setattr(lexical, "stored", noted)
    queries, docs = corpus
    lexical.tfidf_top_k(spark.createDataFrame(queries, IDS), spark.createDataFrame(docs, IDS), 5)
    assert "ShuffledHashJoin" in plans["weights"] and "SortMergeJoin" not in plans["weights"]


def test_terms_are_dealt_out_once_and_pairs_by_document(spark, corpus, monkeypatch):
    """Counting and weighing share a shuffle of hashes, no copy of all terms is written, and no pair is shuffled once for each of its terms."""
    plans, write = {}, lexical.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexical, "stored", lambda df, name: plans.update({name: plan(df)}) or write(df, name))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        queries, docs = corpus
        last = plan(lexical.tfidf_top_k(spark.createDataFrame(queries, IDS), spark.createDataFrame(docs, IDS), 5))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "terms" not in plans and "ReusedExchange" in plans["weights"]
    assert "hashpartitioning(doc_id" in last and not re.search(r"hashpartitioning\(doc_id#\d+L, term#", last)
