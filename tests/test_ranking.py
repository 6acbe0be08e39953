"""The index of blocks and the alignments against full passes, and how little of the data they read."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import alignment, blockmax, retrieve, verify


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of several topics, each with words of its own beside common ones; rows with null and empty texts."""
    rng = random.Random(5)
    common = [f"common{i}" for i in range(30)]
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(40)]
    rows = []
    for i in range(2000):
        own = topics[i % 40]
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.4 else common) for _ in range(rng.randint(5, 60))), f"topic{i % 40}"))
    rows += [(3000, None, "none"), (3001, "", "none"), (3002, "common1 " * 5000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic string")
    queries = [(q, " ".join(rng.choice(topics[q % 40] if rng.random() < 0.5 else common) for _ in range(8)) + " nowhere") for q in range(30)] + [(90, "nowhere at"), (91, ""), (92, None), (93, "common1 common2")]
    return docs, spark.createDataFrame(queries, "q long, text string")


@pytest.fixture(scope="module")
def index(corpus):
    return blockmax.build(corpus[0], "doc_id", {"text": (F.col("text"), 1.0)}, near=[F.col("topic")], block=16)


def full(corpus):
    return retrieve.search_all(corpus[1], "q", F.col("text"), corpus[0], "doc_id", F.col("text"))


@pytest.mark.parametrize("k", [1, 5, 400])
def test_best_of_the_index(spark, corpus, index, k):
    seen: list = []
    got = blockmax.top_k(index, corpus[1], "q", F.col("text"), k, seen=seen).select("q", "doc_id", "score", "hits", "asked", "coverage", "rank")
    want = retrieve.best(full(corpus), "q", [F.desc("score"), F.col("doc_id")], k).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    read, of = blockmax.postings_read(index, *seen, "q")
    if k == 5:
        assert 0 < read < 0.35 * of


def test_cut_off_of_the_index(spark, corpus, index):
    got = retrieve.pruned(blockmax.above(index, corpus[1], "q", F.col("text"), 0.3, 0.5), "q").select("q", "doc_id", "score")
    want = retrieve.pruned(full(corpus), "q").select("q", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fields_have_their_own_statistics(spark):
    docs = spark.createDataFrame([(1, "apple pear", "x"), (2, "plum", "apple apple pear"), (3, None, "pear"), (4, "pear", None)], "d int, title string, body string")
    ask = spark.createDataFrame([(1, "apple pear")], "q int, text string")
    index = blockmax.build(docs, "d", {"title": (F.col("title"), 1.0), "body": (F.col("body"), 0.5)})
    got = {r.d: r.score for r in blockmax.top_k(index, ask, "q", F.col("text"), 9).collect()}
    want: dict = {}
    for field, factor in (("title", 1.0), ("body", 0.5)):
        one = docs.select("d", F.col(field).alias("text"))
        for r in retrieve.search_all(ask, "q", F.col("text"), one, "d", F.col("text")).collect():
            want[r.d] = want.get(r.d, 0) + factor * r.score
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 2e-4 for d in want)


def test_index_of_nothing(spark, corpus):
    empty = blockmax.build(corpus[0].limit(0), "doc_id", {"text": (F.col("text"), 1.0)})
    assert blockmax.top_k(empty, corpus[1], "q", F.col("text"), 5).count() == 0
    assert blockmax.top_k(empty, corpus[1].limit(0), "q", F.col("text"), 5).count() == 0


def plain_places(quote, text):
    n, m = len(quote), len(text)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for x in range(n):
        for y in range(m):
            best[x + 1][y + 1] = best[x][y] + 1 if quote[x] == text[y] else max(best[x][y + 1], best[x + 1][y])
    return best[n][m]


def test_places_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        q, t = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = alignment.aligned_places(q, t)
        it = iter(t)
        assert len(places) == plain_places(q, t) and places == sorted(set(places)) and all(q[p] in it for p in places)


def test_closest_aligns_few(spark, corpus):
    docs, _ = corpus
    rng = random.Random(8)
    rows = docs.filter("length(text) > 60 and doc_id < 2000").orderBy("doc_id").limit(40).collect()
    quotes = []
    for r in rows:
        w = r.text.split()
        quotes.append((r.doc_id, " ".join(x if rng.random() < 0.8 else "other" for x in w[2:18])))
    quotes += [(5000, "not there at all"), (5001, ""), (5002, None)]
    q = spark.createDataFrame(quotes, "q long, text string")
    split = lambda df, key, name: df.select(key, verify.words(F.col("text")).alias(name))
    counts: list = []
    got = {r.q: (r.doc_id, r.matched, len(r.places)) for r in alignment.closest(split(q, "q", "_q"), split(docs, "doc_id", "_d"), "q", "doc_id", counts).collect()}
    want = {r.q: (r.doc_id, r.matched, r.matched) for r in verify.closest(q, docs, "q", "doc_id").collect()}
    assert got == want and sum(counts) < 0.2 * 40 * 2000
