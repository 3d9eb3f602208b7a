"""Each operator against a brute-force version, and on nulls, ties, repeats, empty tables and clashing columns."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import bpe, components, embeddings, html, minhash, packing, quality, token_counts, topk, toxicity, warc
from crestline.llm.queries import vocabulary_path

TEXTS = ["The quick brown fox, again and again.", None, "", "   \n\t ", "x" * 5000, "Ärger im Büro; ΣΊΣΥΦΟΣ İstanbul! <|endoftext|> ok", "it's 12 o'clock… 😀", "The quick brown fox, again and again."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", i) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 1), (0, TEXTS[0], "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long").repartition(3)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_matches_the_library(tokenizer):
    own = bpe.WordBpe(open(vocabulary_path(), "rb").read())
    rng = random.Random(1)
    alphabet = [*"abtheing THE'sΣσς İßéñ́\x1c\x85 ​　\n0٣½中文😀<|>/w_-!$.,", "<|endoftext|>", "</w>", "er", "ing "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(3000)] + ["a" * 3000, "ab" * 500, "é" * 700]
    for text, got in zip(texts, own.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert own.decode(got) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_rows(docs, no_docs, tokenizer):
    out = bpe.encode_decode(docs, vocabulary_path()).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        if r["id"] is not None:
            assert r["ids"] == tokenizer.encode(TEXTS[r["id"]] or "", add_special_tokens=False).ids
    assert bpe.encode_decode(no_docs, vocabulary_path()).count() == 0


def test_packing_covers_each_id_once(docs, no_docs, tokenizer):
    pieces = packing.pack(docs, vocabulary_path(), size=64).collect()
    fills = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 64
    for i in range(1, len(TEXTS)):
        own = sorted((r["start"], r["ids"]) for r in pieces if r["id"] == i)
        ids = [x for _, part in own for x in part]
        assert ids == tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids + [1]
    assert packing.pack(no_docs, vocabulary_path()).count() == 0


def test_packing_wastes_little():
    packer, rng = packing.SquaresPacker(100, most_open=50), random.Random(3)
    for i in range(3000):
        packer.add(i, bytes(4 * rng.choice([30, 60, 61, 120, 250])))
    packer.settle(last=True)
    fills = [sum(len(p[2]) // 4 for p in w) for w in packer.take()]
    assert max(fills) == 100 and sum(f < 100 for f in fills) <= 1


def brute_components(n, linked):
    up = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked(i, j):
                    up[i] = up[j] = min(up[i], up[j])
    return up


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 9), (None, 2), (20, 21), (21, 22), (22, 23), (23, 20), (5, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20}
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.where("false")).count() == 0


def test_minhash_is_brute_force(spark, docs, no_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    rows = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    sets = [set(zip(*[t.split()[k:] for k in range(3)], strict=False)) for _, t in rows]
    want = brute_components(90, lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how in (minhash.MinHash(), minhash.MinHash(block=7)):  # whole buckets, and pairs of small blocks
        got = {r["id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(df, how).collect()}
        assert got == {i: (want[i], len(sets[i])) for i in range(90)}
    odd = {(r["id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert (7, 0, False) in odd and (None, None, True) in odd and {(1, 1, True), (2, 2, True), (3, 3, True)} <= odd
    assert minhash.near_duplicates(no_docs).count() == 0


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(scale=0.18, size=(300, 16)), centres[:1].repeat(20, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (None, x[0].tolist()), (904, [1.0, None]), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = brute_components(len(u), lambda i, j: linked[i, j])
    got = {r["id"]: r for r in embeddings.near_duplicate_vectors(df, embeddings.Cells(per_cell=15, block=8, sample=400)).collect()}
    assert [got[i]["n_links"] for i in range(len(u))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(u))] == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904)) and got[906]["component_id"] == 905
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_of_a_hot_cell_and_clashing_columns(spark):
    """One cell of many blocks and parts of guests; columns that are called like the operator's own."""
    rng = np.random.default_rng(8)
    near = lambda n, d, spread: np.eye(8)[d] + rng.normal(scale=spread, size=(n, 8))
    x = np.concatenate([near(150, 0, 0.11), near(20, 3, 0.3), near(10, 5, 0.02)])
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, digest string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = brute_components(len(u), lambda i, j: linked[i, j])
    for how in (embeddings.Cells(per_cell=1000, block=16, guests=40), embeddings.Cells(per_cell=60, block=16, guests=40, sample=200)):
        got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df, how).collect()}
        assert got == {i: (n, want[i]) for i, n in enumerate(linked.sum(axis=1).tolist())}


def test_vectors_with_repeated_ids_hang_together(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a), (5, b), (7, a), (7, b), (8, [1e-170, 0.0, 0.0]), (9, [1e200, 1e199, 0.0]), (11, c), (11, c)]
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in out) == [(3, 3, 3), (5, 1, 3), (7, 1, 3), (7, 3, 3), (8, 3, 3), (9, 3, 3), (11, 1, 11), (11, 1, 11)]


def best_by_hand(rows, every, k, scale=256):
    ints = [(i, [topk.floored(float(c), scale) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for q, a in sorted(ints, reverse=True):
        if q % every == 0:
            scores = [(-min(topk.MOST_SCORE, max(topk.LEAST_SCORE, sum(x * y for x, y in zip(a, b, strict=True)))), j) for j, b in ints if j != q and len(a) == len(b)]
            out[q] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def top_k_of(df, **how):
    got = {}
    for r in sorted(topk.top_k(df, **how).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(320, 16)).astype(np.float32)
    x[40:60] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [float("inf")] * 16), (None, x[0].tolist()), (1000, [1.0, 2.0]), (1001, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("dim", F.lit("y")).repartition(4)
    want = {q: best for q, best in best_by_hand(rows, 50, 4).items() if best}
    for how in ({"block": 64, "queries_at_once": 3, "few": 8}, {}):
        assert top_k_of(df, k=4, query_every=50, **how) == want
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_of_large_components_and_repeated_ids(spark):
    rows = [(0, [5000.0, 1.0]), (1, [5000.0, -1.0]), (2, [0.5, 0.25]), (3, [1e300, 0.0]), (4, [-1e300, 2.0]), (5, [1.7e308, 1.7e308]), (6, [0.001, 0.002]), (50, [0.1, -0.1]), (7, [0.5, 0.25]), (7, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert top_k_of(df, k=5, query_every=50) == best_by_hand(rows, 50, 5)
    again = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in topk.top_k(again).collect()] == [(0, 1)]


def test_warc_round_trip(spark):
    rows = [(1, "http://Blog.A.com/x?y#z", "<p>é\r\n\r\nx</p>"), (2, None, None), (3, "no url", ""), (4, "http://a.com:8080/", "same"), (9, "http://a.com/", "same"), (None, "http://b.org", "same"), (9, "http://a.com/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.round_trip(pages).collect())
    digest = lambda t: warc.base32_sha1((t or "").encode())
    assert got == [(0, 4, digest("same"), "response", 0), (1, 14, digest(rows[0][2]), "response", 0), (2, 0, digest(""), "revisit", 3), (3, 0, digest(""), "response", 0), (4, 4, digest("same"), "revisit", 9)] + [(9, 4, digest("same"), "response", 0)] * 2
    assert warc.round_trip(pages.where("false")).count() == 0
    assert warc.url_key("http://Blog.x.com:80/a?b#c") == "com,x,blog)/a?b"


def test_warc_finds_urls_with_a_newline(spark):
    rows = [(1, "a\nb", "x"), (2, "a b", "y"), (3, "a%0Ab", "z"), (4, "a!b", "v"), (5, "http://[\n", "w")]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in out) == [1, 2, 3, 4, 5]


def test_warc_of_long_payloads_clashing_columns_and_many_tasks(spark, monkeypatch):
    rng = random.Random(9)
    long_ = "".join(rng.choices("abcdefghijklmnop<>\n", k=2_000_000))
    rows = [(i, f"http://h{i % 7}.com/{i}", long_ if i in (3, 60) else f"page {i % 40}", 1, "x", "y") for i in range(80)] + [(90, "http://a.com/\nline", "break", 1, "x", "y")]
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 10)
    monkeypatch.setattr(warc, "SHARD_CAPTURES", 30)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int, file string, sha string").repartition(5)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    last = {}
    for i, _, html_, *_ in rows:
        last[html_] = max(i, last.get(html_, 0))
    assert got == {i: (len(h), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, _, h, *_ in rows}


def test_toxicity_learns_misspellings(spark, no_docs):
    rng = random.Random(4)
    words, bad = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("rn", "lt", "sk")], ["wrethling", "snarkvile"]
    rows = [(i, " ".join(rng.choices(words, k=30) + (rng.choices(bad, k=3) if i % 3 == 0 else []))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (999, " ".join(rng.choices(words, k=30) + ["wrethlling", "snarkville"])), (1000, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    how = toxicity.Subwords(buckets=1 << 14, steps=150, batch=32)
    out = {r["id"]: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels, how), how).collect()}
    unseen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == int(i % 3 == 0) for i in unseen]) > 0.95 and all(out[i]["held_out"] for i in unseen)
    assert out[999]["predicted"] == 1 and 0 <= out[1000]["score"] <= 1
    assert toxicity.score_toxicity(no_docs, toxicity.fit(no_docs, labels.where("false"), how), how).count() == 0


def test_quality_shrinks_small_sites(spark, no_docs):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["plain", "words", "make", "sentences", "here."], k=40))
    bad = lambda: " ".join(f"{w}$$$" for w in rng.choices(["BUY", "NOW", "CHEAP"], k=40))
    rows = [(i, bad() if i % 4 == 0 else good(), f"h{i % 2}", "p") for i in range(200)] + [(500, good(), None, None), (501, None, "h0", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    how = quality.Quality()
    out = {r["id"]: r for r in quality.score_quality(docs, quality.fit(docs, labels, how), how, F.col("source"), F.col("lang")).collect()}
    assert len(out) == 202 and all(out[i]["keep"] == (i % 4 != 0) for i in range(200))
    assert out[1]["p_host"] > out[2]["p_host"]
    assert quality.score_quality(no_docs, np.zeros(21), how, F.col("source"), F.col("source")).count() == 0


def test_html_consensus(spark):
    page = lambda body: f"<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><a href='/'>menu</a></nav><div class='post-12 entry'>{body}<div class='comments'>ugly &amp; loud</div></div><div id='sidebar'>more</div><footer>end</footer></body></html>"
    rows = [(i, f"http://h.com/{i}", page(f"<h1>Head {i}</h1><p>One &amp; two<br>three<p><b>four </b>  five &#233;")) for i in range(4)] + [(9, "http://h.com/9", None), (10, None, "no markup at all"), (11, "http://[", ""), (12, "http://h.com/12", "<body><p>Only here</p></body>")]
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2] == "Head 2\nOne & two three\nfour five é"
    assert out[9] == out[11] == "" and out[10] == "no markup at all" and out[12] == "Only here"
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def html_texts(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]


def test_html_leaves_out_no_part_of_an_article(spark):
    lead = "<html><body>\n<nav>menu</nav>\n<div class='lead'><p>A short lead.</p></div>\n<div class='story'><p>" + "The long story goes on. " * 3 + "</p></div>\n</body></html>"
    section = "<body><main><article><p>First half of it.</p></article>\n<section><p>Second half.</p></section></main><footer>end</footer></body>"
    links = "<body><div class='list'><p><a href='/1'>One</a></p><p><a href='/2'>Two</a></p></div></body>"
    pages = [(f"http://{host}.com/{i}", page) for host, page in (("a", lead), ("b", section), ("c", links)) for i in range(3)]
    want = ["A short lead.\n" + ("The long story goes on. " * 3).strip(), "First half of it.\nSecond half.", "One\nTwo"]
    assert html_texts(spark, pages) == [text for text in want for _ in range(3)]
    elements = html.parse("<body>\n<div>\n<article><h1>a</h1> <p>b</p></article>\n</div>\n<aside>c</aside></body>")
    assert html.best_container(elements).tag == "article"  # the smallest, white space not counted


def test_html_of_broken_markup_takes_time_by_length():
    stray = "".join(f"<p title='it\"s{i}>text" for i in range(8_000)) + '<a ">"' * 20_000
    deep = "<b>" * 100_000 + "end" + "</i>" * 50_000 + "<hr>" * 20_000
    lists = "<ul><li>" * 30_000 + "<p>x" * 30_000 + "<div" * 50_000
    names = "<div " + "a" * 500_000 + " b=" * 100_000 + ">x</div>" + "<!" * 100_000 + "<title>" * 30_000
    nested = "<div class=sidebar>x" * 30_000 + "y" * 100_000
    for page in (stray, deep, lists, names, nested):
        began = time.process_time()
        elements = html.parse(page)
        html.main_text([html.best_container(elements) or elements[0]])
        assert time.process_time() - began < 12  # two seconds on a machine that isn't slow


def test_html_quotes_and_names_by_hand():
    shown = lambda page: html.main_text([html.best_container(html.parse(page))])
    assert shown("<p title='a>b'>one</p><p title=\"x>y\" hidden>no</p><p>two") == "one\ntwo"
    assert shown("<p title='open>one</p><p>two</p>") == "one\ntwo"
    assert shown("<p data-x=hidden>one</p><article class='post comment-open'>two &lt;b&gt;</article> a < b") == "one\ntwo <b>\na < b"
    assert shown("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\nc\nd\n1\n2\n3"
    assert shown("<script>x('</p>')</script>a<!-- no --><textarea>t</textarea><br>b<![CDATA[x]]>") == "a b"


def test_html_of_a_host_with_two_templates(spark):
    common = "<body><article><p>Post {}.</p></article></body>"
    other = "<body><article>Teaser</article><div class='text'><p>The page's own text, a long one.</p></div></body>"
    want = [f"Post {i}." for i in range(3)] + ["Teaser\nThe page's own text, a long one."]
    for urls in (["http://h.com/1"] * 4, [None, "http://[", "", None]):  # a host, and the pages without one
        assert html_texts(spark, list(zip(urls, [common.format(i) for i in range(3)] + [other], strict=True))) == want


def test_html_keeps_layout_wrappers(spark):
    wrappers = ["<div class='layout with-sidebar'>{}</div>", "<div class=no-sidebar>{}</div>", "<section class='has-banner'>{}</section>", "<div id='content-share'>{}</div>", "<div class='menu-open'>{}</div>", "<article class='post related-open'>{}</article>", "<article class='related'>{}</article>", "<div class='sidebar'>{}</div>"]
    body = "<p>An article that has to stay.</p><div class='site-footer'>foot</div><div class='x comments'>loud</div><div id='ad-2'>buy</div><div class='cookie-notice'>ok</div>"
    pages = [(f"http://w{i}.com/", f"<body>{w.format(body)}</body>") for i, w in enumerate(wrappers)]
    # A small wrapper of that kind, beside more text, stays too.
    pages += [(f"http://s{i}.com/", f"<body>{w.format('<p>Brief.</p>')}<div>{'Much more text. ' * 9}</div></body>") for i, w in enumerate(wrappers[:-1])]
    texts = html_texts(spark, pages)
    assert texts[: len(wrappers)] == ["An article that has to stay."] * len(wrappers)
    assert all(t.startswith("Brief.\nMuch more") for t in texts[len(wrappers) :])


def test_token_counts_are_the_best_segmentation(docs, no_docs):
    costs = {"▁": 1.0, "a": 2.0, "ab": 2.5, "b": 2.0, "▁a": 1.5, "bab": 4.4}
    trie = token_counts.PrefixTrie(costs)

    def best(word):
        if not word:
            return 0.0, 0
        options = [(c + best(word[len(p) :])[0], 1 + best(word[len(p) :])[1]) for p, c in costs.items() if word.startswith(p)]
        n = len(word[0].encode())
        return min([*options, (trie.byte_cost * n + best(word[1:])[0], n + best(word[1:])[1])])

    for text in ["a", "ab", "abab", "bab abab é", "", None, "ababab"]:
        assert trie.count([text])[1][0] == sum(best("▁" + w)[1] for w in (text or "").split())
    assert token_counts.token_counts(docs, vocabulary_path("piece_bpe_32k.model")).count() == len(TEXTS) + 2
    assert token_counts.token_counts(no_docs, vocabulary_path("piece_bpe_32k.model")).count() == 0
