"""Queries of rules: classifiers, packs, routers, validity, sanitising, selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieve, rules
from .registry import query
from .text_queries import DIG, LATIN, words_sql

_L = f"{LATIN % DIG % 'text'}"


@query("injection_rules", f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)ignore (all|the) ') THEN 'override' WHEN regexp_matches(text, '(?i)system') THEN 'role' WHEN regexp_matches({_L}, '\\b(quote|cite)\\b') THEN 'fabrication' WHEN regexp_matches({_L}, '\\bder\\b.*\\bder\\b') THEN 'repeat' END AS kind FROM conversations")
def injection_rules(t):
    """Texts that instruct the machine, or ask it to make something up; ordered, on raw and folded text."""
    low = T.latin(F.col("text"))
    found = [(F.col("text").rlike("(?i)ignore (all|the) "), "override"), (F.col("text").rlike("(?i)system"), "role"), (low.rlike("\\b(quote|cite)\\b"), "fabrication"), (low.rlike("\\bder\\b.*\\bder\\b"), "repeat")]
    return t("conversations").select("conv_id", "turn", rules.first_match(found).alias("kind"))


@query("any_form_match", f"SELECT conv_id, turn, regexp_matches(text, 'é') OR regexp_matches({_L}, '\\bete\\b') OR regexp_matches(replace({_L}, ' ', ''), 'ereis') AS hit FROM conversations")
def any_form_match(t):
    """A predicate on the raw, the folded, or the squeezed text."""
    low = T.latin(F.col("text"))
    return t("conversations").select("conv_id", "turn", (F.col("text").rlike("é") | low.rlike("\\bete\\b") | F.replace(low, F.lit(" "), F.lit("")).rlike("ereis")).alias("hit"))


PACKS = ((1, "under", ("under", "therin")), (2, "particle", ("un", "le", "der")), (3, "ending", ("tion", "ments", "eaux")))
_PACKS = ", ".join(f"({n}, '{name}', '{w}')" for n, name, ws in PACKS for w in ws)


@query("keyword_packs", f"WITH k(ord, pack, w) AS (VALUES {_PACKS}), c AS (SELECT conv_id, turn, ' ' || {_L} || ' ' AS s FROM conversations) SELECT conv_id, turn, first(pack ORDER BY ord) AS pack, count(*) AS n_words FROM c JOIN k ON CASE WHEN length(w) > 4 THEN contains(s, w) ELSE contains(s, ' ' || w || ' ') END GROUP BY conv_id, turn")
def keyword_packs(t):
    """The first pack with a word in the text, a whole word, or a part if it is long; packs are a small fixed table."""
    s = F.concat(F.lit(" "), T.latin(F.col("text")), F.lit(" "))
    hits = F.filter(F.array(*(F.when(s.contains(w if len(w) > 4 else f" {w} "), F.struct(F.lit(n).alias("ord"), F.lit(name).alias("pack"))) for n, name, ws in PACKS for w in ws)), lambda x: x.isNotNull())
    return t("conversations").select("conv_id", "turn", hits.alias("hits")).filter(F.size("hits") > 0).select("conv_id", "turn", F.array_min("hits")["pack"].alias("pack"), F.size("hits").cast("long").alias("n_words"))


@query("question_type", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(is|was|can) ') THEN 'yes_no' WHEN regexp_matches(lower(text), '^(que|was|what) ') THEN 'what' WHEN regexp_matches(text, '\\?') THEN 'open' ELSE 'statement' END AS kind FROM conversations WHERE role = 'user'")
def question_type(t):
    """P5: the kind of a question by its first words."""
    low = F.lower("text")
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", rules.first_match([(low.rlike("^(is|was|can) "), "yes_no"), (low.rlike("^(que|was|what) "), "what"), (F.col("text").rlike("\\?"), "open")], "statement").alias("kind"))


@query("feature_map", f"SELECT conv_id, turn, CASE WHEN strong THEN 'topic' WHEN clock THEN 'clock' WHEN weak AND NOT off THEN 'topic' WHEN off THEN 'off' ELSE 'unknown' END AS feature FROM (SELECT conv_id, turn, regexp_matches({_L}, '\\btion\\b') AS strong, regexp_matches(text, '[0-9]{{1,2}}:[0-9]{{2}}') AS clock, regexp_matches({_L}, '\\b(the|der|les)\\b') AS weak, regexp_matches({_L}, '\\b(un|und)\\b') AS off FROM conversations)")
def feature_map(t):
    """Strong signs win, weak ones only where nothing speaks against them."""
    low = T.latin(F.col("text"))
    strong, clock, weak, off = low.rlike("\\btion\\b"), F.col("text").rlike("[0-9]{1,2}:[0-9]{2}"), low.rlike("\\b(the|der|les)\\b"), low.rlike("\\b(un|und)\\b")
    return t("conversations").select("conv_id", "turn", rules.first_match([(strong, "topic"), (clock, "clock"), (weak & ~off, "topic"), (off, "off")], "unknown").alias("feature"))


_TOOL = "CASE WHEN regexp_matches(text, '(?i)ignore') THEN 'guard' WHEN regexp_matches(text, '[0-9]') THEN 'calculator' WHEN length(text) > 200 THEN 'summary' WHEN regexp_matches(text, '\\?') THEN 'search' ELSE 'chat' END"


@query("tool_router", f"WITH r AS (SELECT conv_id, turn, {_TOOL} AS tool FROM conversations), a(tool) AS (VALUES ('guard'), ('summary'), ('chat')) SELECT conv_id, turn, CASE WHEN a.tool IS NULL THEN 'chat' ELSE r.tool END AS tool, a.tool IS NULL AS fallback FROM r LEFT JOIN a ON a.tool = r.tool")
def tool_router(t):
    """A guard first, then the first tool that fits; one that is not available falls back."""
    rule = rules.first_match([(F.col("text").rlike("(?i)ignore"), "guard"), (F.col("text").rlike("[0-9]"), "calculator"), (F.length("text") > 200, "summary"), (F.col("text").rlike("\\?"), "search")], "chat")
    there = t("conversations").sparkSession.createDataFrame([("guard",), ("summary",), ("chat",)], "tool string").withColumn("there", F.lit(True))
    r = t("conversations").select("conv_id", "turn", rule.alias("tool")).join(F.broadcast(there), "tool", "left")
    return r.select("conv_id", "turn", F.when(F.col("there").isNull(), "chat").otherwise(F.col("tool")).alias("tool"), F.col("there").isNull().alias("fallback"))


@query("request_fields", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^./]+)', 1) AS site, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT) AS page, regexp_extract(url, '[?&]ref=([a-z]+)', 1) AS ref FROM pages")
def request_fields(t):
    """The parts of a request, by patterns; no number is null."""
    u = lambda p: F.regexp_extract("url", p, 1)
    return t("pages").select("page_id", u("^[a-z]+://([^./]+)").alias("site"), u("/([a-z]{2})/").alias("lang"), F.nullif(u("[?&]page=([0-9]+)"), F.lit("")).cast("int").alias("page"), u("[?&]ref=([a-z]+)").alias("ref"))


@query("grade_filter", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'PROMO') THEN 'consensus' WHEN regexp_matches(p_type, 'ECONOMY|STANDARD') THEN 'majority' ELSE 'single' END AS agreement, list_filter([CASE WHEN p_name LIKE '%red%' THEN 'red' END, CASE WHEN p_name LIKE '%bolt%' THEN 'bolt' END, CASE WHEN p_name LIKE '%ring%' THEN 'ring' END], lambda x: x IS NOT NULL) AS named FROM part WHERE regexp_matches(p_name, 'red|blue|small') AND NOT regexp_matches(p_name, 'gizmo|anvil')")
def grade_filter(t):
    """Rows of an allowed grade and no denied one, with tags of agreement and of who is named."""
    n = F.col("p_name")
    tags = F.filter(F.array(*(F.when(n.contains(w), F.lit(w)) for w in ("red", "bolt", "ring"))), lambda x: x.isNotNull())
    kept = t("part").filter(n.rlike("red|blue|small") & ~n.rlike("gizmo|anvil"))
    return kept.select("p_partkey", rules.first_match([(F.col("p_type").rlike("PROMO"), "consensus"), (F.col("p_type").rlike("ECONOMY|STANDARD"), "majority")], "single").alias("agreement"), tags.alias("named"))


@query("coverage_predicate", f"WITH k AS (SELECT item_id, list_distinct(list(w)) AS ks FROM ({words_sql('benchmark', 'item_id')}) GROUP BY item_id HAVING len(list_distinct(list(w))) >= 2), q AS (SELECT item_id, len(ks) AS n, unnest(ks) AS w FROM k), d AS (SELECT DISTINCT doc_id, w FROM ({words_sql('documents', 'doc_id')})) SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS found FROM q JOIN d USING (w) GROUP BY item_id, doc_id, n HAVING count(*) >= 0.8 * n")
def coverage_predicate(t):
    """Documents with at least 80 % of the key words of an item that has two or more."""
    words = lambda df, k: df.select(k, F.array_distinct(T.tokens(F.col("text"), stemmed=False)).alias("ws"))
    q = words(t("benchmark"), "item_id").select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w")).filter("n >= 2")
    d = words(t("documents"), "doc_id").select("doc_id", F.explode("ws").alias("w"))
    return q.join(d, "w").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("found")).filter("found >= 0.8 * n").select("item_id", "doc_id", "found")


@query("response_level", "WITH s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS a, sum(length(text)) AS c, bool_or(role = 'system') AS sys FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN a = 0 THEN 'none' WHEN sys THEN 'guided' WHEN c > 1500 THEN 'long' ELSE 'plain' END AS level, list_filter([CASE WHEN a > 1 THEN 'dialogue' END, CASE WHEN c > 1000 THEN 'detail' END, CASE WHEN n % 2 = 1 THEN 'open' END], lambda x: x IS NOT NULL) AS kinds FROM s")
def response_level(t):
    """The level of a response, and the kinds of matter that it has."""
    s = t("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("a"), F.sum(F.length("text")).alias("c"), F.bool_or(F.col("role") == "system").alias("sys"))
    kinds = F.filter(F.array(F.when(F.col("a") > 1, "dialogue"), F.when(F.col("c") > 1000, "detail"), F.when(F.col("n") % 2 == 1, "open")), lambda x: x.isNotNull())
    return s.select("conv_id", rules.first_match([(F.col("a") == 0, "none"), (F.col("sys"), "guided"), (F.col("c") > 1500, "long")], "plain").alias("level"), kinds.alias("kinds"))


@query("theme_filter", "WITH m AS (SELECT p_partkey, p_brand, string_split(p_name, ' ')[1] IN ('red', 'bolt') AS head FROM part WHERE p_type IN ('PROMO', 'SMALL') AND regexp_matches(p_name, 'red|bolt')) SELECT p_brand, p_partkey, head, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY head DESC, p_partkey) AS INT) AS place FROM m")
def theme_filter(t):
    """Rows of a theme with a word; those with it at their head first."""
    m = t("part").filter(F.col("p_type").isin("PROMO", "SMALL") & F.col("p_name").rlike("red|bolt")).withColumn("head", F.split("p_name", " ")[0].isin("red", "bolt"))
    return m.select("p_brand", "p_partkey", "head", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("head"), "p_partkey")).alias("place"))


@query("interval_validity", "WITH a AS (SELECT l_orderkey, list(struct_pack(s := l_linenumber * 10, e := l_linenumber * 10 + CAST(l_quantity AS INT) % 15) ORDER BY l_linenumber, l_quantity) AS xs, max(l_linenumber) AS last, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(list_filter(xs, lambda x: NOT (x.e >= x.s AND x.e - x.s < 10))) = 0 AS fits, CASE WHEN last = n THEN last END AS timed FROM a")
def interval_validity(t):
    """Passages whose intervals all fit; the last position where it equals the number of rows, else null."""
    x = F.struct((F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 15).alias("e"))
    a = t("lineitem").groupBy("l_orderkey").agg(F.bool_and((x["e"] >= x["s"]) & (x["e"] - x["s"] < 10)).alias("fits"), F.max("l_linenumber").alias("last"), F.count("*").alias("n"))
    return a.select("l_orderkey", "fits", F.when(F.col("last") == F.col("n"), F.col("last")).alias("timed"))


_OK = "regexp_matches(event_type, '^(view|click|purchase)$') AND value > 0"


@query("payload_sanitise", f"SELECT user_id, count(*) FILTER (WHERE {_OK} AND n <= 48) AS kept, count(*) FILTER (WHERE NOT ({_OK})) AS refused, max(substr(props, 1, 7)) AS clipped FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {_OK} ORDER BY event_id) AS n FROM events) GROUP BY user_id")
def payload_sanitise(t):
    """Allowed kinds and values only, texts clipped, at most so many items of each sender."""
    ok = F.col("event_type").rlike("^(view|click|purchase)$") & (F.col("value") > 0)
    e = t("events").withColumn("ok", ok)
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "ok").orderBy("event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("ok") & (F.col("n") <= 48)).alias("kept"), F.count_if(~F.col("ok")).alias("refused"), F.max(T.clip(F.col("props"), 7)).alias("clipped"))


_CONV = "conversations"


@query("own_word_filter", f"WITH s AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), 1) AS i FROM conversations), sw AS (SELECT conv_id, turn, i, unnest(string_split({LATIN % DIG % 's'}, ' ')) AS w FROM s WHERE role = 'assistant'), qw AS (SELECT DISTINCT conv_id, turn + 1 AS turn, w FROM ({words_sql('conversations', 'conv_id', extra=', turn')}) WHERE length(w) >= 3) SELECT DISTINCT conv_id, turn, CAST(i AS BIGINT) AS pos FROM sw JOIN qw USING (conv_id, turn, w)")
def own_word_filter(t):
    """V3: sentences of an answer that share a word of three letters, no stop word, with the turn before."""
    c = t("conversations")
    s = c.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?\\n]+[.!?]*"), F.lit(0))).alias("p", "s"))
    ask = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.filter(T.tokens(F.col("text"), stemmed=False), lambda w: F.length(w) >= 3).alias("asked"))
    return s.join(ask, ["conv_id", "turn"]).filter(F.arrays_overlap(F.split(T.latin(F.col("s")), " "), "asked")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos")).distinct()


@query("selection_order", "WITH a AS (SELECT o_custkey AS q, o_orderkey AS sid, CAST(o_orderkey % 3 AS INT) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders), one AS (SELECT * FROM a WHERE score > 0), none AS (SELECT * FROM a WHERE q NOT IN (SELECT q FROM one) AND pos = 1), al AS (SELECT *, false AS second FROM one UNION ALL SELECT *, true FROM none) SELECT q, sid, score, second, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS INT) AS place, score = 2 AS confirmed FROM al")
def selection_order(t):
    """The chosen ones, score 2 before 1 in given order, confirmed where 2; without any, a second opinion."""
    o = t("orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("sid"), (F.col("o_orderkey") % 3).cast("int").alias("score"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos"))
    one = o.filter("score > 0")
    none = o.filter("pos = 1").join(one, "q", "left_anti")
    both = one.withColumn("second", F.lit(False)).unionByName(none.withColumn("second", F.lit(True)))
    return both.select("q", "sid", "score", "second", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "pos")).alias("place"), (F.col("score") == 2).alias("confirmed"))


@query("shown_labels", "SELECT p_partkey, p_brand AS label, len(list_filter(string_split(p_name, ' '), lambda w: NOT contains('small red bolt ring', w))) = 0 AS shown, list_filter(string_split(p_name, ' '), lambda w: NOT contains('small red bolt ring', w)) AS left_over FROM part")
def shown_labels(t):
    """A label is shown only if all its words are in the query; the words that are left."""
    left = F.filter(F.split("p_name", " "), lambda w: ~F.lit("small red bolt ring").contains(w))
    return t("part").select("p_partkey", F.col("p_brand").alias("label"), (F.size(left) == 0).alias("shown"), left.alias("left_over"))


@query("judge_intersect", "WITH flat AS (SELECT l_orderkey AS q, l_suppkey AS sid FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), judge AS (SELECT l_orderkey AS q, l_suppkey AS sid FROM lineitem WHERE l_quantity > 20 GROUP BY ALL), k AS (SELECT f.q, count(*) AS n, count(j.sid) AS kept FROM flat f LEFT JOIN judge j USING (q, sid) GROUP BY f.q) SELECT q, n, kept, CASE WHEN kept = 0 THEN 'no' WHEN kept = n THEN 'yes' ELSE 'partial' END AS status FROM k")
def judge_intersect(t):
    """V7, V8: what is chosen and confirmed by the judge; whether all, some or none is."""
    rows = lambda c: t("lineitem").filter(c).select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("sid")).distinct()
    k = rows("l_returnflag <> 'N'").join(rows("l_quantity > 20").withColumn("there", F.lit(1)), ["q", "sid"], "left").groupBy("q").agg(F.count("*").alias("n"), F.count("there").alias("kept"))
    return k.select("q", "n", "kept", rules.first_match([(F.col("kept") == 0, "no"), (F.col("kept") == F.col("n"), "yes")], "partial").alias("status"))


@query("glossary_terms", f"WITH g AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS term FROM part), w AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n, count(*) OVER (PARTITION BY item_id) AS words FROM (SELECT item_id, w, i FROM ({words_sql('(SELECT p_partkey AS item_id, p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(32) || p_type ELSE chr(32) END AS text FROM part)', 'item_id')}))) SELECT item_id, min(term) AS term, bool_or(words = 1) AS bare, bool_or(n = 1) AS subject FROM w JOIN g ON g.term = w.w GROUP BY item_id")
def glossary_terms(t):
    """Glossary terms in a text, whether the text is nothing else, and whether one is its first word."""
    g = t("part").select(F.split("p_name", " ")[1].alias("w")).distinct()
    text = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(" "))
    w = t("part").select(F.col("p_partkey").alias("item_id"), T.tokens(text, stemmed=False).alias("ws")).select("item_id", F.size("ws").alias("words"), F.posexplode("ws").alias("p", "w"))
    return w.join(g, "w").groupBy("item_id").agg(F.min("w").alias("term"), F.bool_or(F.col("words") == 1).alias("bare"), F.bool_or(F.col("p") == 0).alias("subject"))


@query("query_rewrite", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(^| )(der|die|das) ', '\1', 'g'), '(en)( |$)', '\2', 'g'), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS rewritten FROM conversations WHERE role = 'user'")
def query_rewrite(t):
    """A query for another search: titles and case endings off, letters only."""
    c = F.lower("text")
    for pattern, by in (("(^| )(der|die|das) ", "$1"), ("(en)( |$)", "$2"), ("[^a-z ]", ""), (" +", " ")):
        c = F.regexp_replace(c, pattern, by)
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", F.trim(c).alias("rewritten"))


@query("topic_subset", "WITH p AS (SELECT list_sort(list_distinct(string_split(p_name, ' '))) AS ws, count(*) AS size FROM part GROUP BY 1), q AS (SELECT n_nationkey AS q, list_sort(list_distinct(['red', 'bolt', 'gear', ['small', 'blue', 'hot', 'old', 'large'][n_nationkey % 5 + 1]])) AS qs FROM nation), m AS (SELECT q, array_to_string(ws, ' ') AS topic, len(ws) AS n, size FROM q JOIN p ON list_has_all(qs, ws) AND len(ws) >= 2) SELECT q, topic FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, size, topic) AS r FROM m) WHERE r = 1")
def topic_subset(t):
    """The topic whose words are all in the query: the longest, then the smallest."""
    p = t("part").select(F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("ws")).groupBy("ws").agg(F.count("*").alias("size")).filter(F.size("ws") >= 2)
    words = F.array(F.lit("red"), F.lit("bolt"), F.lit("gear"), F.element_at(F.array(*map(F.lit, ("small", "blue", "hot", "old", "large"))), F.col("n_nationkey") % 5 + 1))
    q = t("nation").select(F.col("n_nationkey").alias("q"), F.explode(F.array_distinct(words)).alias("w"))
    m = p.select("ws", "size", F.explode("ws").alias("w")).join(q, "w").groupBy("q", "ws", "size").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("ws"))
    topics = m.select("q", F.array_join("ws", " ").alias("topic"), "n", "size")
    return retrieve.best(topics, "q", [F.desc("n"), F.col("size"), F.col("topic")], 1).select("q", "topic")


@query("word_policy", f"WITH v AS (SELECT DISTINCT w FROM ({words_sql('documents', 'doc_id')})), b AS (SELECT DISTINCT item_id, w FROM ({words_sql('benchmark', 'item_id')})), k AS (SELECT item_id, count(*) AS n, count(v.w) AS known FROM b LEFT JOIN v ON v.w = b.w GROUP BY item_id) SELECT item_id, n, known, CASE WHEN known = 0 THEN 'suggest' WHEN known * 2 < n THEN 'weak' ELSE 'answer' END AS policy FROM k")
def word_policy(t):
    """Suggestions only where no word is known, a warning where few are."""
    v = t("documents").select(F.explode(T.tokens(F.col("text"), stemmed=False)).alias("w")).distinct().withColumn("there", F.lit(1))
    b = t("benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text"), stemmed=False))).alias("w"))
    k = b.join(v, "w", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("there").alias("known"))
    return k.select("item_id", "n", "known", rules.first_match([(F.col("known") == 0, "suggest"), (F.col("known") * 2 < F.col("n"), "weak")], "answer").alias("policy"))


@query("unit_cards", "SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(CAST(l_linenumber AS VARCHAR) || '. ' || p_name, '^[0-9]+\\. *', '') AS card FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def unit_cards(t):
    """The card of a unit, its leading number off."""
    j = t("lineitem").filter("l_returnflag = 'R'").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.regexp_replace(F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), "p_name"), "^[0-9]+\\. *", "").alias("card"))


@query("referrals", "WITH m AS (SELECT c_nationkey AS q, c_custkey AS id, c_custkey % 7 = 0 AS model, c_acctbal FROM customer WHERE c_acctbal > 0), a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id) AS n FROM m WHERE model), u AS (SELECT q, id, 0 AS part, n AS k FROM a WHERE n <= 6 UNION ALL SELECT q, id, 1, row_number() OVER (PARTITION BY q ORDER BY c_acctbal DESC, id) FROM m WHERE id NOT IN (SELECT id FROM a WHERE n <= 6)) SELECT q, id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY part, k) AS place FROM u) WHERE place <= 8")
def referrals(t):
    """Given ones first, at most six, then the best matches, eight in all."""
    m = t("customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7 == 0).alias("model"), "c_acctbal")
    first = rules.capped(m.filter("model"), ["q"], [F.col("id")], 6)
    marked = m.join(first.select("id", F.lit(0).alias("part")), "id", "left").withColumn("part", F.coalesce("part", F.lit(1)))
    order = [F.col("part"), F.when(F.col("part") == 0, F.col("id")), F.desc("c_acctbal"), F.col("id")]
    return marked.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy(*order)).alias("place")).filter("place <= 8")


@query("entity_episodes", "WITH e AS (SELECT n_nationkey, n_name FROM nation), h AS (SELECT c_nationkey, c_custkey, c_mktsegment FROM customer), x AS (SELECT h.c_custkey AS id, e.n_nationkey AS entity, h.c_mktsegment = 'BUILDING' AS titled, count(*) FILTER (WHERE h.c_mktsegment = 'BUILDING') OVER (PARTITION BY e.n_nationkey) AS n_titled FROM h JOIN e ON e.n_nationkey = h.c_nationkey) SELECT entity, id, titled FROM x WHERE titled OR n_titled = 0")
def entity_episodes(t):
    """The episodes that name an entity, or its whole group where none does."""
    x = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_nationkey").alias("entity"), (F.col("c_mktsegment") == "BUILDING").alias("titled"))
    without = x.groupBy("entity").agg(F.bool_or("titled").alias("any")).filter("not any")
    return x.filter("titled").select("entity", "id", "titled").union(x.join(without, "entity", "left_semi").select("entity", "id", "titled"))
