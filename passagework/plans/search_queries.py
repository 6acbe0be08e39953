"""Queries of search beyond one ranking: segments, titles, sections, merged quotations, names, cards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import joins, retrieve, rules, scan, within
from ..operators.shared import kept
from .registry import query
from .retrieval_queries import BM25, found_in
from .text_queries import DIG, LATIN, LINE_TEXT_SQL, LINES_SQL, stems_sql, words_sql

#: A thesaurus: group, word. A small fixed table of the caller.
GROUPS = ((1, "tion"), (1, "ment"), (2, "und"), (2, "ndre"), (2, "ing"), (3, "eaux"), (3, "elle"))
_G = ", ".join(f"({g}, '{w}')" for g, w in GROUPS)


def _tokens(df, key):
    return df.select(key, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))


@query("thesaurus_coverage", f"WITH g(gid, token) AS (VALUES {_G}), q AS (SELECT DISTINCT item_id, token FROM ({stems_sql('benchmark', 'item_id')})), e AS (SELECT item_id, q.token AS unit, q.token FROM q UNION SELECT q.item_id, q.token, b.token FROM q JOIN g a ON a.token = q.token JOIN g b ON b.gid = a.gid), d AS (SELECT DISTINCT doc_id, token FROM ({stems_sql('documents', 'doc_id')})), u AS (SELECT DISTINCT item_id, doc_id, unit FROM e JOIN d USING (token)), c AS (SELECT item_id, doc_id, count(*) AS units FROM u GROUP BY ALL) SELECT item_id, doc_id, units, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY units DESC, doc_id) AS rank FROM c) WHERE rank <= 5")
def thesaurus_coverage(t):
    """Queries widened by a table of word groups; a word and its group are one unit of coverage."""
    spark = t("documents").sparkSession
    g = spark.createDataFrame(list(GROUPS), "gid int, token string")
    q = _tokens(t("benchmark"), "item_id").withColumn("unit", F.col("token"))
    pairs = g.join(g.withColumnRenamed("token", "other"), "gid").select("token", "other")
    wide = q.join(F.broadcast(pairs), "token").select("item_id", "unit", F.col("other").alias("token")).union(q.select("item_id", "unit", "token")).distinct()
    u = wide.join(_tokens(t("documents"), "doc_id"), "token").select("item_id", "doc_id", "unit").distinct()
    return retrieve.best(u.groupBy("item_id", "doc_id").agg(F.count("*").alias("units")), "item_id", [F.desc("units"), F.col("doc_id")], 5)


@query("ubiquitous_drop", f"WITH q AS (SELECT DISTINCT item_id, token FROM ({stems_sql('benchmark', 'item_id')})), f AS (SELECT 'documents' AS field, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations), d AS (SELECT 'documents' AS field, token, count(DISTINCT doc_id) AS df FROM ({stems_sql('documents', 'doc_id')}) GROUP BY token UNION ALL SELECT 'conversations', token, count(DISTINCT k) FROM ({stems_sql('(SELECT conv_id * 1000 + turn AS k, text FROM conversations)', 'k')}) GROUP BY token), s AS (SELECT token, max(df / n) AS share FROM d JOIN f USING (field) GROUP BY token), m AS (SELECT q.*, coalesce(share, 0.0) > 0.1 AS weak, count(*) FILTER (WHERE coalesce(share, 0.0) <= 0.1) OVER (PARTITION BY item_id) AS strong FROM q LEFT JOIN s ON s.token = q.token) SELECT item_id, token, weak FROM m WHERE NOT weak OR strong = 0")
def ubiquitous_drop(t):
    """Words that are common in any field are dropped from a query as long as others remain."""
    fields = {"documents": t("documents").select(F.col("doc_id").alias("k"), "text"), "conversations": t("conversations").select(F.struct("conv_id", "turn").alias("k"), "text")}
    shares = None
    for df in fields.values():
        n = df.agg(F.count("*").alias("n"))
        one = _tokens(df, "k").groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", (F.col("df") / F.col("n")).alias("share"))
        shares = one if shares is None else shares.union(one)
    share = shares.groupBy("token").agg(F.max("share").alias("share"))
    m = _tokens(t("benchmark"), "item_id").join(share, "token", "left").withColumn("weak", F.coalesce(F.col("share") > 0.1, F.lit(False)))
    m = m.withColumn("strong", F.count_if(~F.col("weak")).over(Window.partitionBy("item_id")))
    return m.filter("not weak or strong = 0").select("item_id", "token", "weak")


_SEGS = f"""w AS (SELECT item_id, seg, token FROM (SELECT item_id, seg, unnest(string_split(s, ' ')) AS token FROM (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS seg FROM (SELECT item_id, string_split({LATIN % DIG % "coalesce(text, '')"}, ' in ') AS ss FROM benchmark))) WHERE length(token) >= 5)"""


@query("segment_match", f"WITH {_SEGS}, q AS (SELECT DISTINCT item_id, seg, token FROM w), n AS (SELECT item_id, seg, count(*) AS n FROM q GROUP BY ALL), d AS (SELECT DISTINCT doc_id, w AS token FROM ({words_sql('documents', 'doc_id')})), h AS (SELECT item_id, seg, doc_id, count(*) AS hits FROM q JOIN d USING (token) GROUP BY ALL) SELECT item_id, doc_id, bool_or(hits = n) AS full_match, CAST(sum(hits) AS BIGINT) AS hits FROM h JOIN n USING (item_id, seg) GROUP BY item_id, doc_id HAVING bool_or(hits = n)")
def segment_match(t):
    """Queries split at a conjunction; a document matches in full if it has all words of any segment."""
    parts = F.split(T.latin(F.coalesce("text", F.lit(""))), " in ")
    q = t("benchmark").select("item_id", F.posexplode(parts).alias("seg", "s")).select("item_id", "seg", F.explode(F.array_distinct(F.filter(F.split("s", " "), lambda w: F.length(w) >= 5))).alias("token"))
    n = q.groupBy("item_id", "seg").agg(F.count("*").alias("n"))
    d = t("documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), stemmed=False))).alias("token"))
    h = q.join(d, "token").groupBy("item_id", "seg", "doc_id").agg(F.count("*").alias("hits")).join(n, ["item_id", "seg"])
    return h.groupBy("item_id", "doc_id").agg(F.bool_or(F.col("hits") == F.col("n")).alias("full_match"), F.sum("hits").alias("hits")).filter("full_match")


_EXTRA = "(SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) >= 7), ' ') AS text FROM benchmark)"


@query("extra_keywords", f"WITH {BM25}, x AS (SELECT DISTINCT item_id, token FROM ({stems_sql(_EXTRA, 'item_id')})), e AS (SELECT x.item_id, wt.doc_id, round(sum(weight), 4) AS extra FROM x JOIN wt ON wt.token = x.token GROUP BY ALL), m AS (SELECT coalesce(f.item_id, e.item_id) AS item_id, coalesce(f.doc_id, e.doc_id) AS doc_id, round(coalesce(score, 0.0) + 0.6::DOUBLE * coalesce(extra, 0.0), 3) AS total FROM f FULL JOIN e ON e.item_id = f.item_id AND e.doc_id = f.doc_id) SELECT item_id, doc_id, total, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, doc_id) AS rank FROM m) WHERE rank <= 16")
def extra_keywords(t):
    """A second list of keywords (here the words of seven letters and more) counts 0.6 in the ranking."""
    docs = t("documents")
    main = found_in(t).select("item_id", "doc_id", "score")
    keywords = F.array_join(F.filter(F.split("text", " "), lambda w: F.length(w) >= 7), " ")
    extra = found_in(t, t("benchmark").withColumn("text", keywords)).select("item_id", "doc_id", F.col("score").alias("extra"))
    total = F.round(F.coalesce("score", F.lit(0.0)) + 0.6 * F.coalesce("extra", F.lit(0.0)), 3)
    return retrieve.best(main.join(extra, ["item_id", "doc_id"], "full").select("item_id", "doc_id", total.alias("total")), "item_id", [F.desc("total"), F.col("doc_id")], 16)


_TITLES = "(SELECT conv_id, text FROM conversations WHERE turn = 0)"


@query("title_match", f"""WITH t AS (SELECT DISTINCT conv_id, token FROM ({stems_sql(_TITLES, 'conv_id')})), size AS (SELECT conv_id, count(*) AS size FROM t GROUP BY 1), nn AS (SELECT count(*) AS n FROM size), d AS (SELECT token, count(*) AS df FROM t GROUP BY 1), q AS (SELECT DISTINCT item_id, token FROM ({stems_sql('benchmark', 'item_id')})),
i AS (SELECT item_id, token, ln(1 + n / greatest(coalesce(df, 0), 1)) AS idf, coalesce(df, 0) AS df FROM q LEFT JOIN d USING (token) CROSS JOIN nn), total AS (SELECT item_id, sum(idf) AS w, count(*) AS n FROM i GROUP BY 1),
m AS (SELECT i.item_id, t.conv_id, count(*) AS c, sum(idf) AS w, bool_or(i.df <= 15) AS rare FROM i JOIN t USING (token) GROUP BY ALL), s AS (SELECT m.*, m.w / total.w AS cov, c / size AS prec FROM m JOIN total USING (item_id) JOIN size USING (conv_id) WHERE c >= 2 AND total.n >= 2),
k AS (SELECT item_id, conv_id, round(cov * 0.7::DOUBLE + prec * 0.3::DOUBLE, 6) AS score FROM s WHERE (cov * 0.7::DOUBLE + prec * 0.3::DOUBLE >= 0.09 AND prec >= 0.05) OR (prec >= 0.6 AND rare))
SELECT item_id, conv_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id) AS rank FROM k) WHERE rank <= 3""")
def title_match(t):
    """Titles by coverage (idf ln(1 + N / df)) and precision, 0.7 and 0.3; thresholds (low ones here, where the
    texts are invented and share little); the best three."""
    titles = _tokens(t("conversations").filter("turn = 0").select("conv_id", "text"), "conv_id")
    return retrieve.titles(_tokens(t("benchmark"), "item_id"), titles, "item_id", "conv_id", 0.09, 0.05, 0.6, 15, 3)


@query("record_search", f"WITH {BM25} SELECT item_id, doc_id, coverage, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, score DESC, doc_id) AS rank, max(coverage) OVER (PARTITION BY item_id) AS top FROM f) WHERE rank <= CASE WHEN top = 1 THEN 2 ELSE 10 END")
def record_search(t):
    """By coverage, then score; ten records, or only the best two where one covers everything."""
    f = found_in(t).withColumn("top", F.max("coverage").over(Window.partitionBy("item_id")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("coverage"), F.desc("score"), "doc_id"))
    return f.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("top") == 1, 2).otherwise(10)).select("item_id", "doc_id", "coverage", "score", "rank")


@query("anchored_proposals", f"WITH {BM25}, pr AS (SELECT item_id, item_id * 7 % (SELECT n_docs FROM st) + k * 3 AS doc_id, k FROM (SELECT DISTINCT item_id FROM q), (SELECT unnest(range(0, 12)) AS k)), x AS (SELECT pr.*, f.doc_id IS NOT NULL AS anchored FROM pr JOIN documents d ON d.doc_id = pr.doc_id LEFT JOIN f ON f.item_id = pr.item_id AND f.doc_id = pr.doc_id AND f.hits >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, anchored ORDER BY k) AS n FROM x) SELECT item_id, doc_id, anchored FROM r WHERE anchored OR n <= 6")
def anchored_proposals(t):
    """Proposed documents that exist; those that share words are anchored, of the loose ones six at most."""
    n = t("documents").agg(F.count("*").alias("n"))
    q = t("benchmark").select("item_id", F.size(F.array_distinct(T.tokens(F.col("text")))).alias("size")).filter("size > 0").select("item_id").distinct()
    p = q.join(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("item_id", (F.col("item_id") * 7 % F.col("n") + F.col("k") * 3).alias("doc_id"), "k")
    p = p.join(t("documents").select("doc_id"), "doc_id", "left_semi")
    shares = _tokens(t("benchmark"), "item_id").join(p.select("item_id", "doc_id").distinct(), "item_id").join(_tokens(t("documents"), "doc_id"), ["doc_id", "token"])
    hits = shares.groupBy("item_id", "doc_id").agg(F.count("*").alias("hits")).filter("hits >= 5").select("item_id", "doc_id", F.lit(True).alias("anchored"))
    x = p.join(hits, ["item_id", "doc_id"], "left").fillna(False, ["anchored"])
    r = x.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "anchored").orderBy("k")))
    return r.filter("anchored or n <= 6").select("item_id", "doc_id", "anchored")


@query("keyword_baseline", f"WITH d AS (SELECT doc_id, ' ' || {LATIN % DIG % 'text'} || ' ' AS s FROM documents), q AS (SELECT item_id, {LATIN % DIG % 'text'} AS phrase FROM benchmark), x AS (SELECT item_id, list_distinct(string_split(phrase, ' ')) AS ws, phrase FROM q) SELECT item_id, doc_id, contains(s, ' ' || phrase || ' ') AS whole FROM x JOIN d ON contains(s, ' ' || phrase || ' ') OR len(list_filter(ws, lambda w: NOT contains(s, ' ' || w || ' '))) = 0")
def keyword_baseline(t):
    """Documents with the whole query as a phrase, or else with all its words. The query's rarest word proposes the
    documents, so common words join nothing; each proposed text is then checked once."""
    q = t("benchmark").select("item_id", T.latin(F.col("text")).alias("phrase")).withColumn("all", F.array_distinct(F.split("phrase", " ")))
    d = t("documents").select("doc_id", F.explode(F.array_distinct(F.split(T.latin(F.col("text")), " "))).alias("w"))
    each = q.select("item_id", F.explode("all").alias("w"))
    asked = d.join(each.select("w").distinct(), "w", "left_semi")
    seldom = each.join(asked.groupBy("w").agg(F.count("*").alias("df")), "w", "left").groupBy("item_id").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    met = asked.join(seldom, "w").select("item_id", "doc_id").join(q, "item_id")
    texts = t("documents").select("doc_id", F.concat(F.lit(" "), T.latin(F.col("text")), F.lit(" ")).alias("s"))
    within = lambda w: F.contains("s", F.concat(F.lit(" "), w, F.lit(" ")))
    return met.join(texts, "doc_id").filter(F.forall("all", within)).select("item_id", "doc_id", within(F.col("phrase")).alias("whole"))


_SECT = f"x AS ({LINES_SQL}), y AS (SELECT *, CAST(sum(CASE WHEN s LIKE '<h%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS section FROM x)"


@query("section_cut", f"WITH {_SECT} SELECT page_id, section, min(i) AS first, max(i) AS last, count(*) FILTER (WHERE s LIKE '<p%') AS paragraphs, string_agg({LINE_TEXT_SQL}, ' ' ORDER BY i) AS body FROM y WHERE section > 0 GROUP BY page_id, section")
def section_cut(t):
    """Sections from one heading up to the next, with their whole text."""
    d = t("pages").select("page_id", F.posexplode(T.lines(F.col("html"))).alias("p", "s"))
    y = d.withColumn("section", F.sum(F.col("s").startswith("<h").cast("long")).over(Window.partitionBy("page_id").orderBy("p"))).filter("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda x: T.line_text(x["s"])), " ")
    return y.groupBy("page_id", "section").agg((F.min("p") + 1).cast("long").alias("first"), (F.max("p") + 1).cast("long").alias("last"), F.count_if(F.col("s").startswith("<p")).alias("paragraphs"), body.alias("body"))


_PIECE, _INNER = "(?s)<h[1-6]>.*?</h[1-6]>|<p>.*?</p>", "<[^>]*>"


@query("section_rank", f"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '{_PIECE}')) AS s, generate_subscripts(regexp_extract_all(html, '{_PIECE}'), 1) AS i FROM pages),
y AS (SELECT *, s LIKE '<h%' AS head, CAST(sum(CASE WHEN s LIKE '<h%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS section, regexp_replace(s, '{_INNER}', ' ', 'g') AS text FROM x),
w AS (SELECT page_id, section, head, unnest(string_split({LATIN % DIG % 'text'}, ' ')) AS w FROM y WHERE section > 0),
k AS (SELECT page_id, section, w, bool_or(head) AS head FROM w WHERE w <> '' GROUP BY ALL),
f AS (SELECT page_id, section, max(CAST(substr(s, 3, 1) AS INT)) AS level FROM y WHERE head GROUP BY ALL),
q AS (SELECT DISTINCT page_id AS query_id, unnest(string_split({LATIN % DIG % "regexp_extract(html, '<title>([^<]*)', 1)"}, ' ')) AS w FROM pages), n AS (SELECT query_id, count(*) AS n FROM q WHERE w <> '' GROUP BY 1),
m AS (SELECT q.query_id, k.page_id, k.section, any_value(n.n) AS n, count(*) AS hits, count(*) FILTER (WHERE k.head) AS in_heading FROM q JOIN n USING (query_id) JOIN k USING (w) WHERE q.w <> '' AND k.page_id <> q.query_id GROUP BY ALL),
g AS (SELECT *, CASE WHEN in_heading >= CASE WHEN n <= 2 THEN n ELSE ceil(2.0 * n / 3) END THEN in_heading ELSE 0 END AS heads FROM m WHERE hits >= CASE WHEN n <= 2 THEN n ELSE ceil(2.0 * n / 3) END AND (n > 1 OR in_heading = 1))
SELECT query_id, page_id, section, hits, heads, CAST(rank AS INT) AS rank FROM (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY heads DESC, level < 3, hits DESC, g.page_id, g.section) AS rank FROM g JOIN f ON f.page_id = g.page_id AND f.section = g.section) WHERE rank <= 12""")
def section_rank(t):
    """Each page's title asks for sections of other pages. A section must have both words of a title of two, two
    thirds of a longer one's, and a single word in its own heading; those whose heading itself has enough come first, then
    sections deep in the outline, then those with more of the words; the best twelve."""
    piece = F.regexp_extract_all("html", F.lit(_PIECE), F.lit(0))
    d = t("pages").select("page_id", F.posexplode(piece).alias("p", "s"))
    head = F.col("s").startswith("<h")
    y = d.withColumn("section", F.sum(head.cast("long")).over(Window.partitionBy("page_id").orderBy("p"))).filter("section > 0")
    split = lambda c: F.filter(F.split(T.latin(c), " "), lambda w: w != "")
    words = lambda some: F.array_distinct(split(F.array_join(F.collect_list(F.when(some, F.regexp_replace("s", _INNER, " "))), " ")))
    level = F.max(F.when(head, F.substring("s", 3, 1).cast("int"))).alias("level")
    rows = kept(y.groupBy("page_id", "section").agg(level, words(F.lit(True)).alias("ts"), words(head).alias("hs")), "sections")
    title = F.array_distinct(split(F.regexp_extract("html", "<title>([^<]*)", 1)))
    found = scan.sections(kept(t("pages").select(F.col("page_id").alias("query_id"), title.alias("ts")), "titles"), rows, 12)
    if found is None:  # nothing is asked
        found = rows.filter("false").select(F.col("page_id").alias("query_id"), "page_id", "section", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("heads"), "level")
    order = [F.desc("heads"), F.col("level") < 3, F.desc("hits"), F.col("page_id"), F.col("section")]
    return retrieve.best(found, "query_id", order, 12).select("query_id", "page_id", "section", "hits", "heads", "rank")


@query("four_list_fusion", f"""WITH {BM25}, l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank, 0 AS list_no FROM f UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) - 1, 1 FROM f UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id DESC) - 1, 2 FROM f UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1, 3 FROM f),
m AS (SELECT item_id, doc_id, min(rank * 1000 + list_no) AS place FROM l WHERE rank < 30 GROUP BY ALL) SELECT item_id, doc_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place, doc_id) AS rank FROM m) WHERE rank <= 36""")
def four_list_fusion(t):
    """Four rankings interleaved, the first sight of a document counts, thirty-six at most."""
    orders = [[("score", False), ("key", True)], [("coverage", False), ("key", True)], [("hits", False), ("key", False)], [("key", True)]]
    found = retrieve.listed(t("benchmark"), "item_id", F.col("text"), t("documents"), "doc_id", F.col("text"), orders, 30)
    lists = None
    for no, order in enumerate(orders):
        own = [(F.col if rising else F.desc)("doc_id" if c == "key" else c) for c, rising in order]
        one = retrieve.best(found.filter(F.col("list_no") == no), "item_id", own, 30).select("item_id", "doc_id", (F.col("rank") - 1).alias("rank"), F.lit(no).alias("list_no"))
        lists = one if lists is None else lists.unionByName(one)
    return retrieve.round_robin(lists, "item_id", "doc_id", 36).select("item_id", "doc_id", "rank")


_TURNS = f"SELECT conv_id, turn, {LATIN % DIG % 'text'} AS s FROM conversations"
_SPANQ = "q AS (SELECT a.conv_id AS q_conv, a.turn AS q_turn, array_to_string(list_concat(a.wa[greatest(1, len(a.wa) - 2):len(a.wa)], b.wb[1:3]), ' ') AS quote FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


@query("quote_spans", f"WITH p AS ({_TURNS}), w0 AS (SELECT conv_id, turn, s, string_split(s, ' ') AS ws FROM p), w AS (SELECT conv_id, turn, ws AS wa, ws AS wb FROM w0), {_SPANQ}, o AS (SELECT conv_id, turn, s, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p), g AS (SELECT conv_id, ' ' || string_agg(s, ' ' ORDER BY turn) || ' ' AS whole FROM p GROUP BY 1), h AS (SELECT q_conv, q_turn, g.conv_id, instr(whole, ' ' || quote || ' ') AS place, length(quote) AS n FROM q JOIN g ON contains(whole, ' ' || quote || ' ')) SELECT q_conv, q_turn, h.conv_id, min(o.turn) AS first_turn, max(o.turn) AS last_turn FROM h JOIN o ON o.conv_id = h.conv_id AND o.start < place - 1 + n AND o.start + length(o.s) > place - 1 GROUP BY ALL")
def quote_spans(t):
    """Quotations across consecutive passages of a group (here the end of each turn and the start of
    the next).
    Each group's words run on; the quotation's words are found by an equal join on three of them and then checked."""
    c = t("conversations").select("conv_id", "turn", F.split(T.latin(F.col("text")), " ").alias("ws"))
    nxt = F.lead("ws").over(Window.partitionBy("conv_id").orderBy("turn"))
    end = F.slice("ws", F.greatest(F.lit(1), F.size("ws") - 2), 3)
    q = c.withColumn("b", nxt).filter("b is not null").select(F.struct("conv_id", "turn").alias("qid"), F.concat(end, F.slice("b", 1, 3)).alias("quote"))
    spans = joins.quote_spans(q, c, "qid", "quote", "conv_id", "turn", "ws")
    return spans.select(F.col("qid.conv_id").alias("q_conv"), F.col("qid.turn").alias("q_turn"), "conv_id", "first_turn", "last_turn")


@query("merged_quotes", f"WITH w AS (SELECT doc_id, string_split({LATIN % DIG % 'text'}, ' ') AS ws FROM documents), q AS (SELECT a.doc_id AS qid, list_concat(a.ws[1:5], b.ws[1:5]) AS qs FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 WHERE len(a.ws) >= 5 AND len(b.ws) >= 5), d AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM w), c AS (SELECT qid, unnest(range(3, 8)) AS h, qs FROM q), x AS (SELECT qid, h, ' ' || array_to_string(qs[1:h], ' ') || ' ' AS head, ' ' || array_to_string(qs[h + 1:10], ' ') || ' ' AS tail, ' ' || array_to_string(qs, ' ') || ' ' AS whole FROM c), a AS (SELECT qid, h, min(doc_id) AS da, max(doc_id) AS da2 FROM x JOIN d ON contains(s, head) GROUP BY ALL), b AS (SELECT qid, h, min(doc_id) AS db, max(doc_id) AS db2 FROM x JOIN d ON contains(s, tail) GROUP BY ALL), e AS (SELECT DISTINCT qid FROM x JOIN d ON contains(s, whole)) SELECT q.qid, CASE WHEN e.qid IS NOT NULL THEN 'exact' WHEN m.qid IS NOT NULL THEN 'merged' ELSE 'notfound' END AS verdict FROM q LEFT JOIN e ON e.qid = q.qid LEFT JOIN (SELECT DISTINCT a.qid FROM a JOIN b ON a.qid = b.qid AND a.h = b.h WHERE NOT (da = da2 AND db = db2 AND da = db)) m ON m.qid = q.qid")
def merged_quotes(t):
    """Quotations put together from two documents: a prefix and the rest, of three words at least, each in another
    one. Whole parts are found by their first three words and then checked."""
    w = t("documents").select("doc_id", F.split(T.latin(F.col("text")), " ").alias("ws"))
    a = kept(w.select("doc_id", F.slice("ws", 1, 5).alias("ws")), "starts").filter("size(ws) = 5")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("wb"))
    q = a.join(b, "doc_id").select(F.col("doc_id").alias("qid"), F.concat(F.slice("ws", 1, 5), F.slice("wb", 1, 5)).alias("quote"))
    return joins.merged_quotes(q, w, "qid", "quote", "doc_id", "ws")


@query("contained_translations", f"WITH q AS (SELECT item_id, {LATIN % DIG % 'text'} AS s, len(string_split({LATIN % DIG % 'text'}, ' ')) AS n FROM benchmark) SELECT item_id, doc_id FROM q JOIN documents d ON n >= 3 AND contains(' ' || {LATIN % DIG % 'd.text'} || ' ', ' ' || s || ' ')")
def contained_translations(t):
    """Texts of three words and more that are contained word by word in another one."""
    q = t("benchmark").select("item_id", F.split(T.latin(F.col("text")), " ").alias("ws")).filter("size(ws) >= 3").select("item_id", F.col("ws").alias("quote"))
    d = t("documents").select("doc_id", F.split(T.latin(F.col("text")), " ").alias("ws"))
    return joins.holding(q, d, "item_id", "quote", "doc_id", "ws").select("item_id", "doc_id").distinct()


_NAME = "regexp_replace(lower({c}), '^(the|small|large) ', '')"


@query("name_resolution", f"WITH a AS (SELECT p_name AS alias, min(p_partkey) AS id, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1), k AS (SELECT {_NAME.format(c='alias')} AS key, min(id) AS id FROM a GROUP BY 1), q AS (SELECT s_suppkey AS qid, CASE s_suppkey % 4 WHEN 0 THEN 'red bolt' WHEN 1 THEN 'the hot gear' WHEN 2 THEN 'smal bolt' ELSE 'unheard of' END AS asked FROM supplier), f AS (SELECT qid, asked, alias, levenshtein(asked, alias) AS d FROM q JOIN a ON abs(length(asked) - length(alias)) <= 1 AND levenshtein(asked, alias) <= 1), u AS (SELECT qid, min(alias) AS alias FROM (SELECT *, min(d) OVER (PARTITION BY qid) AS best FROM f) WHERE d = best GROUP BY qid HAVING count(*) = 1) SELECT q.qid, CASE WHEN e.alias IS NOT NULL THEN 'exact' WHEN k.key IS NOT NULL THEN 'stripped' WHEN u.alias IS NOT NULL THEN 'near' ELSE 'none' END AS kind, coalesce(e.id, k.id, n.id) AS id FROM q LEFT JOIN a e ON e.alias = q.asked LEFT JOIN k ON k.key = {_NAME.format(c='q.asked')} LEFT JOIN u ON u.qid = q.qid LEFT JOIN a n ON n.alias = u.alias")
def name_resolution(t):
    """A name as it is, without lead words, or the only one within an edit; ties resolve to none."""
    a = t("part").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("id"))
    strip = lambda c: F.regexp_replace(F.lower(c), "^(the|small|large) ", "")
    k = a.groupBy(strip(F.col("alias")).alias("key")).agg(F.min("id").alias("key_id"))
    asked = F.element_at(F.array(*map(F.lit, ("red bolt", "the hot gear", "smal bolt", "unheard of"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    q = t("supplier").select(F.col("s_suppkey").alias("qid"), asked.alias("asked"))
    names = q.select("asked").distinct()
    near = joins.fuzzy(names, a.select("alias"), F.col("asked"), F.col("alias"), 1, [F.col("asked"), F.col("alias")])
    best = near.withColumn("least", F.min("distance").over(Window.partitionBy("asked"))).filter("distance = least").groupBy("asked").agg(F.count("*").alias("n"), F.min("alias").alias("alias")).filter("n = 1")
    near = best.join(a.withColumnRenamed("id", "near_id"), "alias").select("asked", "near_id")
    x = q.join(a.select(F.col("alias").alias("asked"), F.col("id").alias("exact_id")), "asked", "left").withColumn("key", strip(F.col("asked"))).join(k, "key", "left").join(near, "asked", "left")
    kind = rules.first_match([(F.col("exact_id").isNotNull(), "exact"), (F.col("key_id").isNotNull(), "stripped"), (F.col("near_id").isNotNull(), "near")], "none")
    return x.select("qid", kind.alias("kind"), F.coalesce("exact_id", "key_id", "near_id").alias("id"))


@query("topic_table", "WITH k(topic, w, needed) AS (VALUES ('fixings', 'bolt', true), ('fixings', 'small', false), ('fixings', 'red', false), ('fixings', 'blue', false), ('drives', 'gear', true), ('drives', 'hot', false), ('drives', 'old', false)), w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part), n AS (SELECT p_partkey, count(*) AS n FROM w GROUP BY 1) SELECT p_partkey, topic FROM w JOIN k USING (w) JOIN n USING (p_partkey) GROUP BY p_partkey, topic, n HAVING count(*) = n AND bool_or(needed)")
def topic_table(t):
    """Topics whose list allows every word of a text, with one that it needs."""
    rows = [("fixings", "bolt", True), ("fixings", "small", False), ("fixings", "red", False), ("fixings", "blue", False), ("drives", "gear", True), ("drives", "hot", False), ("drives", "old", False)]
    k = t("part").sparkSession.createDataFrame(rows, "topic string, w string, needed boolean")
    ws = t("part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("ws"))
    m = ws.select("p_partkey", F.size("ws").alias("n"), F.explode("ws").alias("w")).join(F.broadcast(k), "w").groupBy("p_partkey", "topic", "n").agg(F.count("*").alias("c"), F.bool_or("needed").alias("needed"))
    return m.filter("c = n and needed").select("p_partkey", "topic")


_SENT = "s AS (SELECT doc_id, i AS pos, s FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: length(trim(s)) >= 12) AS x FROM documents)))"


@query("brief_sentences", f"WITH {_SENT}, k AS (SELECT doc_id, pos, s AS text FROM s), tok AS (SELECT DISTINCT doc_id, pos, token FROM ({stems_sql('k', 'doc_id, pos')})), q AS (SELECT DISTINCT item_id, token FROM ({stems_sql('benchmark', 'item_id')})), c AS (SELECT item_id, doc_id, pos, count(*) AS n FROM q JOIN tok USING (token) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, pos) AS one FROM c), f AS (SELECT item_id, doc_id, min(pos) AS first_hit FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id, pos) AS rank FROM o WHERE one = 1) SELECT item_id, doc_id, pos, first_hit, n, CAST(rank AS INT) AS rank FROM r JOIN f USING (item_id, doc_id) WHERE rank <= 3")
def brief_sentences(t):
    """Of each passage the best sentence, of these the best three; and the passage's first sentence with a hit."""
    docs = t("documents").select(F.col("doc_id").cast("long"), F.transform(T.sentences(F.col("text")), lambda s: F.array_distinct(T.tokens(s))).alias("ss"))
    q = t("benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("ts"))
    best = scan.sentences(q, docs, "item_id", "doc_id", 3)
    if best is None:  # nothing is asked
        best = q.filter("false").select("item_id", *(F.lit(0).cast("long").alias(c) for c in ("doc_id", "pos", "first_hit", "n")))
    return retrieve.best(best, "item_id", [F.desc("n"), F.col("doc_id")], 3)


@query("aspect_lookup", "WITH RECURSIVE nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent, p_name AS name FROM part WHERE p_partkey > 0), up AS (SELECT id, parent, 1 AS depth FROM nodes WHERE name LIKE '% bolt' UNION ALL SELECT up.id, n.parent, depth + 1 FROM up JOIN nodes n ON n.id = up.parent), m AS (SELECT up.id, up.parent AS subject, depth FROM up JOIN nodes n ON n.id = up.parent WHERE n.name LIKE 'red %') SELECT id, first(subject ORDER BY depth) AS subject, CAST(min(depth) AS INT) AS depth FROM m GROUP BY id")
def aspect_lookup(t):
    """Headings of an aspect with their nearest ancestor of a subject."""
    from ..operators import tree

    p = F.col("p_partkey")
    nodes = t("part").filter(p > 0).select(p.alias("id"), F.when(p > 2, F.floor(p / 3)).alias("parent"))
    names = t("part").select(p.alias("id"), F.col("p_name").alias("name"))
    up = tree.nearest_above(nodes, names.filter("name like 'red %'").select("id"))
    return up.join(names.filter("name like '% bolt'").select("id"), "id", "left_semi").select("id", F.col("ancestor").alias("subject"), "depth")


@query("unused_notes", "WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_returnflag <> 'R') SELECT o_orderkey, n.l_linenumber AS note, n.l_partkey AS part FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey AND i = 1")
def unused_notes(t):
    """Each passage with its first note that is not used up, or none."""
    n = rules.capped(t("lineitem").filter("l_returnflag <> 'R'"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 1)
    return t("orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.col("l_linenumber").alias("note"), F.col("l_partkey").alias("part"))


@query("zone_country", "SELECT n_regionkey AS zone, first(n_name ORDER BY n_nationkey) AS country FROM nation GROUP BY 1")
def zone_country(t):
    """The first country of each zone."""
    return t("nation").groupBy(F.col("n_regionkey").alias("zone")).agg(F.min_by("n_name", "n_nationkey").alias("country"))


@query("word_results", f"WITH x AS (SELECT source, doc_id, count(*) AS n FROM ({words_sql('documents', 'doc_id', extra=', source')}) WHERE w IN ('tion', 'eaux', 'ing', 'whst') GROUP BY ALL) SELECT source, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM x) WHERE i <= 60")
def word_results(t):
    """Z3: passages with one of some words, in canonical order, sixty of a group at most."""
    hit = F.filter(T.tokens(F.col("text"), stemmed=False), lambda w: w.isin("tion", "eaux", "ing", "whst"))
    x = t("documents").select("source", "doc_id", F.size(hit).cast("long").alias("n")).filter("n > 0")
    return rules.capped(x, ["source"], [F.col("doc_id")], 60).select("source", "doc_id", "n")


@query("entity_cards", "WITH s AS (SELECT c_nationkey AS e, min(c_custkey) AS id, 1 AS part FROM customer GROUP BY 1), n AS (SELECT c_nationkey AS e, c_custkey AS id, 2 AS part FROM customer WHERE c_mktsegment = 'BUILDING'), x AS (SELECT c_nationkey AS e, c_custkey AS id, 3 AS part FROM customer WHERE c_acctbal > 5000), u AS (SELECT * FROM s UNION ALL SELECT * FROM n UNION ALL SELECT * FROM x WHERE id NOT IN (SELECT id FROM n)) SELECT e, id, part, CAST(row_number() OVER (PARTITION BY e ORDER BY part, id) AS INT) AS place FROM u")
def entity_cards(t):
    """The card of an entity: its summary, what names it, and what is only indexed."""
    c = t("customer").select(F.col("c_nationkey").alias("e"), F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal")
    named = c.filter("c_mktsegment = 'BUILDING'").select("e", "id")
    summary = c.groupBy("e").agg(F.min("id").alias("id")).withColumn("part", F.lit(1))
    rest = c.filter("c_acctbal > 5000").select("e", "id").join(named, ["e", "id"], "left_anti").withColumn("part", F.lit(3))
    u = summary.union(named.withColumn("part", F.lit(2))).union(rest)
    return u.select("e", "id", "part", F.row_number().over(Window.partitionBy("e").orderBy("part", "id")).alias("place"))


@query("quotation_audit", r"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<.]{12,})', 1)) AS quote FROM pages), q AS (SELECT DISTINCT page_id, quote FROM h), w AS (SELECT page_id, quote, trim(regexp_replace(lower(quote), '[^a-z0-9]+', ' ', 'g')) AS k FROM q), p AS (SELECT page_id AS src, ' ' || trim(regexp_replace(lower(html), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM pages) SELECT w.page_id, w.quote, count(p.src) AS sources FROM w LEFT JOIN p ON p.src <> w.page_id AND contains(s, ' ' || k || ' ') WHERE len(string_split(k, ' ')) >= 3 GROUP BY ALL")
def quotation_audit(t):
    """Quotations out of texts, each looked up in all other ones; how many have it word by word."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    q = t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<p>([^<.]{12,})"), F.lit(1)))).alias("quote"))
    q = kept(q.withColumn("k", plain(F.col("quote"))).filter(F.size(F.split("k", " ")) >= 3), "quotations")
    p = t("pages").select(F.col("page_id").alias("src"), plain(F.col("html")).alias("s"))
    found = kept(within.holders(q.select("k"), p, "k", "src", "s"), "found")  # equal quotations are looked up once
    own = found.withColumnRenamed("src", "page_id").withColumn("own", F.lit(1))
    n = F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))
    hits = q.join(found.groupBy("k").agg(F.count("*").alias("n")), "k", "left").join(own, ["k", "page_id"], "left")
    return hits.select("page_id", "quote", n.cast("long").alias("sources"))


@query("answer_cache", "WITH cached AS (SELECT DISTINCT sha256(p_name) AS key FROM part WHERE p_partkey % 2 = 0), a AS (SELECT p_name, sha256(p_name) AS key, count(*) AS n FROM part GROUP BY 1) SELECT p_name, a.n, c.key IS NOT NULL AS cached FROM a LEFT JOIN cached c ON c.key = a.key")
def answer_cache(t):
    """Answers that a cache has, and those that still have to be made."""
    key = F.sha2("p_name", 256)
    cached = t("part").filter("p_partkey % 2 = 0").select(key.alias("key")).distinct().withColumn("there", F.lit(True))
    a = t("part").groupBy("p_name").agg(F.count("*").alias("n")).withColumn("key", key)
    return a.join(cached, "key", "left").select("p_name", "n", F.coalesce("there", F.lit(False)).alias("cached"))


@query("catch_up_portions", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS done FROM events GROUP BY ALL), s AS (SELECT user_id, day, done, CAST(coalesce(sum(done) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM d) SELECT user_id, day, greatest(0, n * 20 - before) AS due, done > greatest(0, n * 20 - before) AS extra FROM s")
def catch_up_portions(t):
    """What is due on a day by the snapshot of all before it, with what is to be caught up; whether more is done."""
    d = activity_daily(t)
    w = Window.partitionBy("user_id").orderBy("day")
    before = F.coalesce(F.sum("done").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due = F.greatest(F.lit(0), F.col("n") * 20 - F.col("before"))
    return d.withColumn("before", before).withColumn("n", F.row_number().over(w)).select("user_id", "day", due.alias("due"), (F.col("done") > due).alias("extra"))


def activity_daily(t):
    return t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("done"))


@query("memory_checks", f"WITH w AS (SELECT item_id, string_split({LATIN % DIG % 'text'}, ' ') AS ws FROM benchmark), r AS (SELECT item_id, ws, list_filter(ws, lambda x, i: i % 7 <> 0) AS said FROM w), s AS (SELECT item_id, len(ws) AS m, len(said) AS hit, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END AS extra FROM r) SELECT item_id, round((hit - 0.5::DOUBLE * extra) / m, 6) AS score, (hit - 0.5::DOUBLE * extra) / m >= 0.9 AS ok FROM s")
def memory_checks(t):
    """What was said from memory (here every seventh word left out, sometimes two added) against the text, by the
    longest common subsequence of words; the score takes half of what is added off."""
    from ..operators import verify

    ws = F.split(T.latin(F.col("text")), " ")
    said = F.concat(F.filter(ws, lambda x, i: (i + 1) % 7 != 0), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("0added0"), F.lit("0more0"))).otherwise(F.array().cast("array<string>")))
    x = verify.common_words(t("benchmark").select("item_id", ws.alias("ws"), said.alias("said")), "ws", "said")
    score = (F.col("common") - 0.5 * (F.size("said") - F.col("common"))) / F.size("ws")
    return x.select("item_id", F.round(score, 6).alias("score"), (score >= 0.9).alias("ok"))
