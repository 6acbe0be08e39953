"""What larger tables and odd values showed: small cases that the code before did not pass."""

import math
import random

from pyspark.sql import functions as F

from passagework.functions import words as W
from passagework.operators import dense, forms, joins, retrieve, scan, within


def test_projection_rounds_as_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    rows = [(0, [0.00001]), (1, [-0.00001]), (2, [0.5, None, 0.25]), (3, []), (4, [None]), (5, None), (6, [1e307]), (7, [0.03125, -0.0625]), (8, [float("inf"), 1.0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, repr(r.projected)) for r in df.select("vec_id", dense.project(F.col("embedding"), 5, 8).alias("projected")).collect())
    assert got == sorted((k, repr(v)) for k, v in con.execute(entry.oracle_sql()["vector_project"]).fetchall())
    assert math.copysign(1, spark.range(1).select(dense.rounded(F.lit(-0.00001), 4)).first()[0]) == -1


def test_long_names_that_share_a_half_are_not_paired(spark):
    """Numbered names have their first half in common: what meets in the join must not be every pair."""
    names = [f"Customer#{i:09d}" for i in range(0, 4000, 7)] + ["Customer#0000001234", "Customer#00000007", "ustomer#000000014", "a" * 12, "a" * 13, "a" * 11 + "b", None]
    df = spark.createDataFrame([(x,) for x in names], "name string")
    asked = df.select(F.col("name").alias("a"), F.explode(joins.near_keys(F.col("name"), 1, True)).alias("k"))
    known = df.select(F.col("name").alias("b"), F.explode(joins.near_keys(F.col("name"), 1, False)).alias("k"))
    assert asked.join(known, "k").select("a", "b").distinct().count() < 40 * len(names)
    got = {tuple(r) for r in joins.fuzzy(df.withColumnRenamed("name", "a"), df.withColumnRenamed("name", "b"), F.col("a"), F.col("b"), 1, [F.col("a"), F.col("b")]).collect()}
    pairs = df.select(F.col("name").alias("a")).join(df.select(F.col("name").alias("b"))).withColumn("distance", F.levenshtein("a", "b")).filter("distance <= 1")
    assert got == {tuple(r) for r in pairs.collect()}


def test_products_with_directions_are_a_step_of_their_own(spark):
    """As dot() has them bit by bit, and not written out in the plan, where each use would work them out anew."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [None] * 7)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    directions = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(4)]
    made = df.select("id", dense.onto(F.col("v"), directions).alias("p"))
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = df.select("id", F.array(*[dense.dot(F.col("v"), F.array(*map(F.lit, d))) for d in directions]).alias("p"))
    got, want = ({r.id: r.p for r in x.collect()} for x in (made, want))
    assert all(got[i] == want[i] for i in range(50))
    assert made.filter(dense.usable(F.col("p"))).count() == 50


def test_quotations_that_many_share_are_not_paired(spark):
    """Three hundred texts with one beginning: what goes on from the search grows with the texts, not with their pairs."""
    docs = spark.createDataFrame([(i, f"we all say the same thing here {i} and then word{i} ends it") for i in range(300)], "id long, s string")
    quotes = spark.createDataFrame([(i, "we all say the same thing here") for i in range(300)] + [(900, f"7 and then word7 {'z ' * 40}end"), (901, "word9 ends it"), (902, "ends it")], "q long, s string")
    found = within.holders(quotes.select("s"), docs.withColumnRenamed("s", "t"), "s", "id", "t")
    assert sorted(tuple(r) for r in found.groupBy("s").count().collect()) == [("we all say the same thing here", 300), ("word9 ends it", 1)]
    cuts = quotes.filter("q < 300").withColumn("cuts", F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(7).cast("long").alias("n")))).select("q", "s", "cuts")
    runs = within.numbered(cuts, "s")
    assert runs.select("h1", "h2").distinct().count() == 1
    assert within.met(runs, docs, "id", "s").count() == 300


def test_merged_quotations_equal_a_plain_loop(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 14))] for _ in range(60)]
    quotes = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(80)] + [t[:7] for t in texts] + [t[:4] + u[1:5] for t, u in zip(texts, texts[1:], strict=False)]
    has = lambda t, q: any(t[k : k + len(q)] == q for k in range(len(t) - len(q) + 1))
    want = {}
    for i, q in enumerate(quotes):
        halves = [[{k for k, t in enumerate(texts) if has(t, part)} for part in (q[:h], q[h:])] for h in range(3, len(q) - 2)]
        merged = any(a and b and len(a | b) > 1 for a, b in halves)
        want[i] = "exact" if len(q) >= 3 and any(has(t, q) for t in texts) else "merged" if merged else "notfound"
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, ws array<string>")
    got = joins.merged_quotes(spark.createDataFrame(list(enumerate(quotes)), "q long, quote array<string>"), docs, "q", "quote", "id", "ws")
    assert dict(got.collect()) == want and set(want.values()) == {"exact", "merged", "notfound"}


def same_as_sql(spark, name, folder, **tables):
    """A query on given tables against its SQL, and how many rows it has."""
    import duckdb

    import __spark_entry__ as entry
    import compare

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(2).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    df, rel = entry.queries()[name](spark, str(folder)), con.execute(entry.oracle_sql()[name])
    heads, cols = [d[0] for d in rel.description], sorted(df.columns)
    mine = sorted(repr(tuple(compare.norm(r[c]) for c in cols)) for r in df.collect())
    assert mine == sorted(repr(tuple(compare.norm(r[heads.index(c)]) for c in cols)) for r in rel.fetchall())
    return len(mine)


def test_shared_paragraphs_are_counted_not_paired(spark, tmp_path):
    shared = "<p>the same notice on every page</p>"
    pages = spark.createDataFrame([(i, f"<p>own words number {i} here</p>{shared}<p>a b</p>" + (shared if i % 3 else "")) for i in range(200)], "page_id long, html string")
    assert same_as_sql(spark, "quotation_audit", tmp_path, pages=pages) == 400
    runs = spark.createDataFrame([("the same notice on every page",)] * 200, "k string")
    docs = spark.createDataFrame([(i, f"x{i} the same notice on every page") for i in range(200)], "src long, s string")
    assert within.holders(runs, docs, "k", "src", "s").count() == 200  # for 200 equal quotations in 200 texts


def test_titles_that_share_words_pass_on_their_best_sections(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    html = lambda: f"<title>{some(rng.randint(0, 4))}</title>" + "".join(f"<h{rng.randint(1, 4)}>{some(2)}</h1><p>{some(5)}</p>" for _ in range(rng.randint(0, 4)))
    pages = spark.createDataFrame([(i, html()) for i in range(120)], "page_id long, html string")
    assert same_as_sql(spark, "section_rank", tmp_path, pages=pages) > 500
    rows = spark.range(0, 5000, 1, 2).select(F.col("id").alias("page_id"), F.lit(1).cast("long").alias("section"), F.lit(2).alias("level"), F.array(F.lit("a"), F.lit("b")).alias("ts"), F.array(F.lit("a")).alias("hs"))
    titles = spark.createDataFrame([(7, ["a", "b"]), (8, ["a"]), (9, ["b"]), (10, [])], "query_id long, ts array<string>")
    got = scan.sections(titles, rows, 12).collect()
    assert len(got) == 2 * 2 * 12 and {r.query_id for r in got} == {7, 8}


def _texts(spark, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40)]
    text = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
    docs = spark.createDataFrame([(i, text()) for i in range(n)] + [(n, None), (n + 1, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, text()) for i in range(12)] + [(50, "nowhere"), (51, None)], "item_id long, text string")


def test_lists_are_cut_before_hits_are_shuffled(spark, tmp_path):
    docs, asked = _texts(spark, 400)
    assert same_as_sql(spark, "four_list_fusion", tmp_path, documents=docs, benchmark=asked) == 12 * 36
    found = retrieve.listed(asked, "item_id", F.col("text"), docs.coalesce(2), "doc_id", F.col("text"), [[("score", False), ("key", True)]], 5)
    assert found.count() <= 2 * 5 * 12


def test_brief_sentences_are_cut_before_hits_are_shuffled(spark, tmp_path):
    docs, asked = _texts(spark, 300)
    assert same_as_sql(spark, "brief_sentences", tmp_path, documents=docs, benchmark=asked) == 12 * 3
    rows = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.array(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b"))).alias("ss"))
    got = scan.sentences(spark.createDataFrame([(1, ["a", "b"])], "item_id long, ts array<string>"), rows, "item_id", "doc_id", 3).collect()
    assert len(got) == 2 * 3 and {(r.pos, r.first_hit, r.n) for r in got} == {(2, 1, 2)}


def test_cut_offs_and_ranks_without_an_index(spark, tmp_path):
    """As of all hits; and no step keeps postings."""
    docs, asked = _texts(spark, 300)
    docs = docs.withColumn("source", F.concat(F.lit("src"), F.col("doc_id") % 3))
    assert same_as_sql(spark, "group_rank", tmp_path, documents=docs, benchmark=asked.union(spark.createDataFrame([(60, "w1 w2"), (61, "w3")], "item_id long, text string"))) == 14 * 3
    tables = {x.name for x in spark.catalog.listTables()}
    assert same_as_sql(spark, "bm25_pruned", tmp_path / "b", documents=docs, benchmark=spark.createDataFrame([(60, "w1 w2"), (61, "w3"), (62, "w1 w2 w3 w4 w5 w6 w7 w8 nowhere"), (63, "w4 w5 w6 w7 w8"), (64, None)], "item_id long, text string")) > 50
    assert {x.name for x in spark.catalog.listTables()} == tables


def test_forms_of_words_where_texts_lie(spark, tmp_path):
    """An id that comes twice is one passage, a row without an id none; forms are the JVM's."""
    docs = spark.createDataFrame([(1, "book books boook aa1"), (2, "book bk bkk"), (2, "books teeth"), (None, "lonely book"), (4, None), (5, ""), (6, "11 ii a3 aei")], "doc_id long, text string")
    assert same_as_sql(spark, "latin_forms", tmp_path, documents=docs) > 10
    rng = random.Random(1)
    words = spark.createDataFrame([("".join(rng.choice("aeioub1") for _ in range(rng.randint(1, 8))),) for _ in range(300)], "w string")
    assert all(forms.sound_forms(r.w) == r.f for r in words.select("w", W.sound_forms(F.col("w")).alias("f")).collect())
