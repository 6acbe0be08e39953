import datetime as dt

import pytest
from pyspark.sql import functions as F

from passagework.functions import geo
from passagework.functions import text as T
from passagework.operators import activity, evaluation, gather, joins, retrieve, rules, tree, verify
from passagework.sources import files
from passagework.streaming import events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("value", "f", "want"),
    [
        ("Crème BRÛLÉE, ٣!", T.latin, "creme brulee 3"),
        ("stories running glasses", lambda c: T.tokens(c, stop=()), ["story", "run", "glass"]),
        (None, T.tokens, []),
        ("One two three. Four five six!\nNo", T.sentences, ["One two three.", " Four five six!"]),
        ("alpha beta gamma", lambda c: T.truncate(c, 12), "alpha beta…"),
        ("<p>a &amp; b</p><script>x</script>", T.strip_html, "a & b"),
        ("abc", lambda c: T.subsequence(c, F.lit("xaxbxc")), True),
        ("acb", lambda c: T.subsequence(c, F.lit("xaxbxc")), False),
        ("noise {\"k\": 1} tail", T.json_in, '{"k": 1}'),
    ],
)
def test_text(spark, value, f, want):
    assert one(spark, value, f) == want


def test_every_passage_finds_itself(spark):
    docs = spark.createDataFrame([(i, f"alpha{i} common word{i % 3} tail") for i in range(12)], "id int, text string")
    weighted = retrieve.weights(retrieve.postings(docs, "id", F.col("text")))
    found = retrieve.search(docs.withColumnRenamed("id", "q"), "q", F.col("text"), weighted, "id")
    best = retrieve.best(found, "q", [F.desc("score"), F.col("id")], 1)
    assert all(r.q == r.id for r in best.collect()) and best.count() == 12


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "nine ten")], "d int, text string")
    quotes = spark.createDataFrame([(1, "Three four, five six seven"), (2, "three four five sax seven eight"), (3, "ten"), (4, "nothing here")], "q int, text string")
    assert {(r.q, r.d) for r in verify.contained(quotes, docs, "q", "d").collect()} == {(1, 1), (3, 2)}
    got = {r.q: r.verdict for r in verify.verdicts(quotes, docs, "q", "d").collect()}
    assert got == {1: "exact", 2: "near", 3: "exact"}


def test_lcs():
    assert verify._lcs(list("abcbdab"), list("bdcaba")) == 4 and verify._lcs([], ["a"]) == 0


def test_joins(spark):
    left = spark.createDataFrame([("u", 5, "a"), ("u", 1, "b"), ("v", 9, "c")], "k string, t int, e string")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("v", 10, 1)], "k string, t int, x int")
    assert {(r.e, r.x) for r in joins.as_of(left, right, ["k"], "t", ["x"]).collect()} == {("a", 50), ("b", None), ("c", None)}
    points, ranges = spark.createDataFrame([(i,) for i in range(20)], "p int"), spark.createDataFrame([(3, 11), (11, 12)], "lo int, hi int")
    hit = joins.range_join(points, ranges, F.col("p"), F.col("lo"), F.col("hi"), 4, [F.col("p"), F.col("lo")])
    assert sorted(map(tuple, hit.collect())) == sorted([(p, 3) for p in range(3, 12)] + [(11, 11), (12, 11)])


def test_fuzzy_finds_all(spark):
    import random

    random.seed(1)
    words = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(150)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    a, b = spark.createDataFrame([(w,) for w in words[::2]], "a string"), spark.createDataFrame([(w,) for w in words], "b string")
    got = {tuple(r) for r in joins.fuzzy(a, b, F.col("a"), F.col("b"), 2, [F.col("a"), F.col("b")]).collect()}
    assert got == {(x, y, d) for x in words[::2] for y in words if (d := distance(x, y)) <= 2}


def test_streaks(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in (1, 2, 3, 7, 8)] + [(2, dt.date(2024, 1, 1))], "u int, day date")
    assert {(r.u, r.streak) for r in activity.streak(days, ["u"], F.lit(dt.date(2024, 1, 9))).collect()} == {(1, 2), (2, 0)}


def test_evaluation(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "q string, d string, rank int")
    judged = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "x")], "q string, d string")
    got = {r.q: (r.hit, r.recall, r.reciprocal_rank, r.average_precision) for r in evaluation.rank_metrics(run, judged, "q", "d").collect()}
    assert got == {"q": (1, 1.0, 0.5, 0.583333), "r": (0, 0.0, 0.0, 0.0)}
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert evaluation.kappa(same, "a", "b").first().kappa == 1.0


def test_tree_with_cycle_ends(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, parent int")
    up = {(r.id, r.ancestor) for r in tree.ancestors(nodes, 5).collect()}
    assert (3, 1) in up and (8, 9) in up and (1, 2) not in up


def test_rules_and_budget(spark):
    df = spark.createDataFrame([(1, 1, "aa bb", "s"), (1, 2, "AA, bb", "t"), (1, 3, "x" * 50, "s"), (1, 4, "cc", "s")], "q int, r int, text string, src string")
    kept = verify.within_budget(df, "q", "r", "text", "src", 20, 2)
    assert sorted(r.r for r in kept.collect()) == [1, 4]
    kind = rules.first_match([(F.col("r") > 3, "late"), (F.col("r") > 1, "mid")], "first")
    assert [r[0] for r in df.orderBy("r").select(kind).collect()] == ["first", "mid", "mid", "late"]


def test_geo(spark):
    row = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0))).first()
    assert abs(row[0] - 20015.1145) < 0.01 and abs(row[1] - 90) < 1e-9


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n1|2|x|y\n\n3|4|z\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "a.txt"), ["a", "b", "t"]).collect()] == [("1", "2", "x|y"), ("3", "4", "z")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.append_new(df, str(tmp_path / "t"), ["k"]) == 2
    assert files.append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), str(tmp_path / "t"), ["k"]) == 1
    (tmp_path / "m.bin").write_bytes(bytes(range(6)))
    assert [r.v for r in files.read_matrix(spark, str(tmp_path / "m.bin"), 3).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert files.manifest(spark, str(tmp_path / "m.bin")).first().n_bytes == 6


def test_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 10), 1, "view") for i in range(9)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    assert [tuple(r)[1:] for r in events.daily_counts(spark.read.parquet(str(tmp_path / "e.parquet"))).collect()] == [("view", 9)]
    limited = events.rate_limited(events.as_stream(spark.read.parquet(str(tmp_path / "e.parquet"))), 3, 60)
    q = limited.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("limited").orderBy("event_id").collect()] == [True] * 3 + [False] * 3 + [True] * 3

def test_evidence_is_the_greedy_choice_from_all_rows(spark):
    import random

    random.seed(4)
    rows = [("q", d, 0, 9, 20, "same") for d in range(300)] + [("q", d % 40, 1 + d, 8, 90, f"long{d}") for d in range(200)] + [("q", 500 + d, 0, 7, random.randint(12, 40), f"k{d % 150}") for d in range(250)]
    rows += [("r", 1, d, 5, 15, f"x{d}") for d in range(120)] + [("r", 2, 0, 1, 15, "y"), ("s", 1, 0, 1, 5000, "z")]
    df = spark.createDataFrame(rows, "q string, d long, pos int, score long, length int, key string")
    got = sorted((r.q, r["rank"], r.d, r.pos) for r in verify.evidence(df, "q", "score", "d", "pos", 600, 2, step=30).collect())
    want = []
    for q in "qrs":
        left, seen, used = 600, set(), {}
        for rank, (_, d, pos, _, n, key) in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1], r[2])), 1):
            if key not in seen and used.get(d, 0) < 2 and n <= left:
                seen.add(key)
                used[d] = used.get(d, 0) + 1
                left -= n
                want.append((q, rank, d, pos))
    assert got == sorted(want) and len({x for x in want if x[0] == "q"}) > 5


def test_gathered_evidence_is_the_choice_from_scored_rows(spark):
    import random

    random.seed(9)
    texts = [" ".join(random.choices("abcdefghij", k=random.randint(1, 8))) for _ in range(60)]
    rows = [(d % 120, d // 120, t, t.split()) for d, t in enumerate(random.choices(texts, k=600))] + [(500, 0, "", []), (None, 0, "a", ["a"])]
    s = spark.createDataFrame(rows, "d long, pos int, key string, ts array<string>").withColumn("length", F.length("key") + 3)
    q = spark.createDataFrame([(i, random.sample("abcdefghijk", 4)) for i in range(6)] + [(7, []), (8, ["zz"])], "q int, ts array<string>")
    tok = s.filter("d is not null").select("d", "pos", "length", "key", F.explode(F.array_distinct("ts")).alias("w"))
    scored = q.select("q", F.explode("ts").alias("w")).join(tok, "w").groupBy("q", "d", "pos", "length", "key").agg(F.count("*").alias("score"))
    for step, words in ((3, 10), (96, 20_000)):
        want = sorted(map(tuple, verify.evidence(scored, "q", "score", "d", "pos", 90, 2).select("q", "rank", "d", "pos", "score").collect()))
        got = sorted(map(tuple, gather.evidence(q, s.repartition(4), "q", "d", "pos", 90, 2, step, words).select("q", "rank", "d", "pos", "score").collect()))
        assert got == want and len(want) > 20
    assert gather.evidence(q.limit(0), s, "q", "d", "pos", 90, 2).count() == 0 == gather.evidence(q, s.limit(0), "q", "d", "pos", 90, 2).count()


def test_deep_and_wide_trees(spark):
    deep = spark.range(1, 71).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))
    assert tree.ancestors(deep).count() == 70 * 71 // 2
    wide = spark.range(1, 200_001).select("id", F.when(F.col("id") > 1, F.greatest(F.lit(1), F.floor(F.col("id") / 3))).alias("parent"))
    found = tree.ancestors(wide)
    assert found.count() > 1_000_000 and found.filter("ancestor = 1").count() == 200_000
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int"))


def test_closest_of_all_documents(spark):
    import random

    random.seed(6)
    vocabulary = [f"w{i}" for i in range(30)]
    quotes = {i: [random.choice(vocabulary) for _ in range(n)] for i, n in enumerate((1, 3, 8, 12, 64, 65, 20, 20))}
    texts = {i: [random.choice(vocabulary) for _ in range(random.randint(0, 200))] for i in range(120)}
    texts |= {1000 + i: vocabulary[::-1] * 3 for i in range(60)}  # all words, in another order
    texts[5000] = [*quotes[6][:9], "zz", *quotes[6][9:]]
    texts[5001] = ["a", *quotes[7], "b"]
    q = spark.createDataFrame([(k, " ".join(w)) for k, w in quotes.items()] + [(99, "unseen")], "q int, text string")
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()] + [(-1, None)], "d int, text string")
    got = {r.q: (r.matched, r.d) for r in verify.closest(q, d, "q", "d", block_words=100).collect()}
    want = {k: max(((verify._lcs(w, x), -i) for i, x in texts.items())) for k, w in quotes.items()}
    assert got == {k: (n, -i) for k, (n, i) in want.items()}
    found = {r.q: (r.d, r.verdict) for r in verify.verdicts(q, d, "q", "d").collect()}
    assert found[6] == (5000, "near") and found[7] == (5001, "exact")


def test_stream_reads_every_file_of_a_table(spark, tmp_path):
    from passagework.streaming import events

    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 4, "view") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, by in (("plain", []), ("parted", ["user_id"])):
        path = str(tmp_path / name)
        df.repartition(4).write.partitionBy(*by).parquet(path)
        assert sum(r.n for r in events.daily_counts(spark.read.parquet(path)).collect()) == 40


def test_names_by_deletion_neighbourhoods(spark):
    import random

    from passagework.operators import joins

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    a, b = (spark.createDataFrame([(x,) for x in part], f"{c} string") for part, c in ((names[::2], "a"), (names[1::2], "b")))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for most in (1, 2):
        got = sorted((r.a, r.b, r.distance) for r in joins.fuzzy(a, b, F.col("a"), F.col("b"), most, [F.col("a"), F.col("b")]).collect())
        assert got == sorted((x, y, d) for x in names[::2] for y in names[1::2] if (d := distance(x, y)) <= most)


def test_words_alone(spark):
    from passagework.functions import words

    rows = [("rereading", "cat", "cah"), ("", "", "a"), (None, None, None), ("undergoings", "the", "tht")]
    got = spark.createDataFrame(rows, "w string, a string, b string").select(words.affix_stem(F.col("w")).alias("s"), words.distance_free_end(F.col("a"), F.col("b"), "th").alias("d"), words.sound_key(F.col("w")).alias("k")).collect()
    assert [(r.s, r.d) for r in got] == [("read", 0), ("", 1), (None, None), ("going", 1)]


def test_nearest_in_blocks(spark):
    import numpy as np

    from passagework.operators import dense

    rng = np.random.default_rng(2)
    m = rng.standard_normal((90, 6))
    m[30:35] = m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = sorted((r.q, r["rank"], r.id) for r in dense.nearest(df.filter("id % 9 = 0"), df, "q", "id", "v", 4, 20, 3).collect())
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for q in range(0, 90, 9):
        s = np.round(u @ u[q], 6)
        want += [(q, k + 1, i) for k, (_, i) in enumerate(sorted((-s[i], i) for i in range(90) if i != q)[:4])]
    assert got == sorted(want)


def test_principal_directions(spark):
    import numpy as np

    from passagework.operators import dense

    rng = np.random.default_rng(4)
    m = rng.standard_normal((200, 5)) * [5, 3, 2, 1, 0.5]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 5), (902, [1.0]), (903, [float("nan")] * 5), (904, [None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = dense.principal(df, "v", 5, 3)
    right = np.linalg.svd(m / np.linalg.norm(m, axis=1, keepdims=True), full_matrices=False)[2][:3]
    assert np.allclose(np.abs(np.sum(np.array(got) * right, axis=1)), 1)
    there = np.array([r[0] for r in df.filter("id < 200").orderBy("id").select(dense.onto(F.col("v"), got)).collect()])
    assert np.allclose(there, m @ np.array(got).T)
    assert len(dense.principal(df.filter("id < 0"), "v", 5, 2)) == 2


def test_spoken_passes(spark):
    lists = {"filler": ["uh"], "polite": ["please"], "q": ["what", "how"], "want": ["want"], "ask": ["tell"], "frame_verb": ["says"], "subject": ["it", "book"], "prep": ["about", "of"], "lone": ["me"]}
    cases = {
        "uh what says it book about patience": "patience",
        "what book says it": "",
        "please tell about me how people what": "how people what",
        "please tell me patience": "patience",
        "tell me of people": "of people",
        "i uh need patience": "patience",
        "patience says it book of people": "patience people",
        "it": "it",
        "people about": "people about",
        "what": "",
    }
    rows = [(k, i, w) for k, text in enumerate(cases) for i, w in enumerate(text.split(" "))]
    r = rules.spoken(spark.createDataFrame(rows, "k int, i int, w string"), ["k"], "i", "w", lists, {"i need": "want"}).collect()
    for k, want in enumerate(cases.values()):
        assert " ".join(x.w for x in sorted(r, key=lambda x: x.i) if x.k == k and x.kind is None) == want
    with pytest.raises(ValueError, match="ends as another"):
        rules.spoken(spark.createDataFrame(rows, "k int, i int, w string"), ["k"], "i", "w", lists, {"a b": "ask", "b c": "ask"})


def test_aligned(spark):
    from passagework.functions import words

    rows = [(["one", "too", "three"], ["x", "on", "two", "y", "tree"]), ([], ["a"]), (["a"], []), (None, ["a"])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(words.aligned(F.col("a"), F.col("b"))).collect()]
    assert got == [[2, 3, 5], [], [None], None]
