"""Queries over words and short texts: stems, forms, keys, repair, units, chunks, references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import forms, joins, retrieve
from ..operators.shared import kept
from .registry import query
from .text_queries import DIG, LATIN, words_sql

_VOC = f"voc AS (SELECT w AS word, count(*) AS total FROM ({words_sql('documents', 'doc_id')}) GROUP BY w)"
PRE, SUF, TWO = ("re", "un", "in"), ("ed", "er", "ing", "es"), ("an", "en")


def _vocabulary(t):
    return t("documents").select(F.explode(T.tokens(F.col("text"), stemmed=False)).alias("word")).groupBy("word").agg(F.count("*").alias("total"))


def _cut_sql(w: str) -> str:
    tests = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= {4 if len(s) == 1 else 3} THEN substr({w}, 1, length({w}) - {len(s)})" for s in W.SUFFIXES)
    return f"CASE WHEN length({w}) <= 3 THEN {w} {tests} ELSE {w} END"


_BARE = "CASE " + " ".join(f"WHEN starts_with(word, '{p}') AND length(word) - {len(p)} >= 2 THEN substr(word, {len(p) + 1})" for p in W.PREFIXES) + " ELSE word END"


@query("affix_stems", f"""WITH RECURSIVE {_VOC}, r AS (SELECT word, {_BARE} AS w FROM voc UNION SELECT word, {_cut_sql('w')} FROM r)
SELECT word, arg_min(w, length(w)) AS stem FROM r GROUP BY word""")
def affix_stems(t):
    """T5: one prefix off, then suffixes as long as one can go, over the distinct words."""
    return _vocabulary(t).select("word", W.affix_stem(F.col("word")).alias("stem"))


_ART = "CASE WHEN starts_with(word, 'the') AND length(word) >= 6 THEN substr(word, 4) WHEN starts_with(word, 'an') AND length(word) >= 5 THEN substr(word, 3) ELSE word END"
_PLU = "CASE WHEN ends_with(b, 'es') AND length(b) >= 5 THEN substr(b, 1, length(b) - 2) WHEN ends_with(b, 's') AND length(b) >= 4 THEN substr(b, 1, length(b) - 1) ELSE b END"


@query("root_keys", f"""WITH {_VOC}, a AS (SELECT word, total, {_ART} AS b FROM voc), p AS (SELECT word, total, {_PLU} AS c FROM a),
k AS (SELECT word, total, CASE WHEN length(regexp_replace(c, '[aeiou]', '', 'g')) >= 2 THEN regexp_replace(c, '[aeiou]', '', 'g') ELSE c END AS k FROM p)
SELECT coalesce(s.root, k.k) AS root, count(*) AS n_words, CAST(sum(total) AS BIGINT) AS total FROM k LEFT JOIN (VALUES ('nd', 'n'), ('ndn', 'n'), ('rr', 'r')) s(k, root) ON s.k = k.k GROUP BY 1""")
def root_keys(t):
    """Article, plural and weak letters off, then a table of synonyms; words and occurrences of each root."""
    spark = t("documents").sparkSession
    same = spark.createDataFrame([("nd", "n"), ("ndn", "n"), ("rr", "r")], "key string, root string")
    k = _vocabulary(t).withColumn("key", W.root_key(F.col("word")))
    return k.join(F.broadcast(same), "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.count("*").alias("n_words"), F.sum("total").alias("total"))


def _off(c: str, values, side: str) -> str:
    tests = {"p": "SELECT word, {c} AS x FROM {{f}}", "s": "SELECT word, {c} AS x FROM {{f}}"}[side].format(c=c)
    return tests + "".join(f" UNION ALL SELECT word, " + (f"substr({c}, {len(v) + 1}) FROM {{f}} WHERE starts_with({c}, '{v}')" if side == "p" else f"substr({c}, 1, length({c}) - {len(v)}) FROM {{f}} WHERE ends_with({c}, '{v}')") for v in values)


@query("clitic_forms", f"""WITH {_VOC}, f0 AS ({_off('word', PRE, 'p').format(f='voc')}), f1 AS ({_off('x', PRE, 'p').format(f='f0')}), f2 AS ({_off('x', SUF, 's').format(f='f1')}),
f3 AS (SELECT * FROM f2 UNION ALL SELECT word, substr(x, 1, length(x) - 1) || 'y' FROM f2 WHERE ends_with(x, 'i')), d AS (SELECT DISTINCT word, x FROM f3 WHERE length(x) >= 3 AND x <> word)
SELECT d.word, count(*) AS n_bases, first(d.x ORDER BY v.total DESC, d.x) AS best FROM d JOIN voc v ON v.word = d.x GROUP BY d.word""")
def clitic_forms(t):
    """Words that another word may come from by prefixes and a suffix; those of the vocabulary, the most used first."""
    v = _vocabulary(t)
    forms = v.select("word", F.explode(W.base_forms(F.col("word"), PRE, SUF)).alias("x")).filter("x <> word")
    found = forms.join(v.select(F.col("word").alias("x"), "total"), "x")
    return found.groupBy("word").agg(F.count("*").alias("n_bases"), F.min_by("x", F.struct(-F.col("total"), F.col("x"))).alias("best"))


@query("attached_forms", f"""WITH {_VOC}, q AS (SELECT DISTINCT w AS word FROM ({words_sql('benchmark', 'item_id')})),
f AS (SELECT word, word AS form FROM q {''.join(f" UNION ALL SELECT word, '{p}' || word FROM q" for p in PRE)} {''.join(f" UNION ALL SELECT word, word || '{s}' FROM q" for s in SUF)})
SELECT f.word, f.form, v.total FROM f JOIN voc v ON v.word = f.form""")
def attached_forms(t):
    """A query word with prefixes and suffixes attached, as far as the corpus has them."""
    q = t("benchmark").select(F.explode(T.tokens(F.col("text"), stemmed=False)).alias("word")).distinct()
    forms = q.select("word", F.explode(W.attached_forms(F.col("word"), PRE, SUF)).alias("form"))
    return forms.join(_vocabulary(t).withColumnRenamed("word", "form"), "form").select("word", "form", "total")


def _sound_sql(w: str) -> str:
    for a, b in (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u")):
        w = f"replace({w}, '{a}', '{b}')"
    return f"array_to_string(list_filter(string_split({w}, ''), lambda c, i: i = 1 OR c <> string_split({w}, '')[i - 1]), '')"


@query("latin_forms", f"""WITH x AS (SELECT DISTINCT doc_id, w FROM ({words_sql('documents', 'doc_id')})), k AS (SELECT w, {_sound_sql('w')} AS k FROM (SELECT DISTINCT w FROM x)),
f AS (SELECT w, unnest(list_distinct(list_filter([k, regexp_replace(k, '[aeiou]$', ''), CASE WHEN length(regexp_replace(k, '[aeiou]', '', 'g')) >= 3 THEN regexp_replace(k, '[aeiou]', '', 'g') END], lambda z: z IS NOT NULL AND length(z) > 0))) AS form FROM k)
SELECT form, count(DISTINCT x.doc_id) AS docs, count(DISTINCT f.w) AS words, min(x.doc_id) AS first_doc FROM f JOIN x ON x.w = f.w GROUP BY form""")
def latin_forms(t):
    """Transliteration keys and forms of words, and the distinct passages of each form."""
    docs = t("documents").select("doc_id", "text")
    again = kept(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if not again.isEmpty():  # rows of one id are one passage
        whole = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        docs = docs.join(again, "doc_id", "left_anti").union(whole)
    return forms.of_texts(docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"), stemmed=False)).alias("ws")), "doc_id")


_COUNTED = "CASE WHEN n = 0 THEN 'no orders' WHEN n = 1 THEN 'one order' WHEN n = 2 THEN 'a pair of orders' WHEN n <= 10 THEN translate(CAST(n AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' orders' ELSE translate(CAST(n AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' one order' END"


@query("counted_nouns", f"WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, {_COUNTED} AS phrase FROM n")
def counted_nouns(t):
    """Numbers with their noun, in the digits of a language."""
    n = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", W.counted(F.col("n"), "one order", "a pair of orders", "orders", ("0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("phrase"))


_FREE = "least(levenshtein(q.w, v.word), CASE WHEN right(q.w, 1) IN ('t', 'h', 'e') AND right(v.word, 1) IN ('t', 'h', 'e') THEN levenshtein(left(q.w, length(q.w) - 1), left(v.word, length(v.word) - 1)) END)"
_SUBSEQ = "regexp_matches({b}, array_to_string(string_split({a}, ''), '.*'))"
_RANKED = f"""{_VOC}, q AS (SELECT DISTINCT left(w, 3) || substr(w, 5) AS w FROM ({words_sql('benchmark', 'item_id')}) WHERE length(w) >= 4),
d AS (SELECT q.w AS word, v.word AS suggestion, v.total, {_FREE} AS distance FROM q JOIN voc v ON abs(length(q.w) - length(v.word)) <= 2 AND length(v.word) >= 3 AND q.w <> v.word),
n AS (SELECT *, {_SUBSEQ.format(a='word', b='suggestion')} OR {_SUBSEQ.format(a='suggestion', b='word')} AS sub FROM d WHERE distance <= CASE WHEN length(word) >= 7 THEN 2 ELSE 1 END),
s AS (SELECT *, round(distance * 10 - CASE WHEN sub THEN 4 ELSE 0 END - CASE WHEN left(word, 1) = left(suggestion, 1) THEN 2 ELSE 0 END - 0.6::DOUBLE * log2(1 + total), 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score, suggestion) AS rank FROM s)"""


def _misspelt(t):
    """Query words without their fourth letter; what is left has three letters at least."""
    w = t("benchmark").select(F.explode(T.tokens(F.col("text"), stemmed=False)).alias("w")).filter(F.length("w") >= 4)
    return w.select(F.concat(F.substring("w", F.lit(1), F.lit(3)), F.substring("w", F.lit(5), F.length("w"))).alias("word")).distinct()


def _suggestions(t, vocabulary):
    s = joins.suggestions(_misspelt(t), vocabulary.withColumnRenamed("word", "suggestion"), "word", "suggestion", "total", alike="the")
    best = retrieve.best(s, "word", [F.col("score"), F.col("suggestion")], 4)
    sure = (F.col("rank") == 1) & (F.col("distance") <= 1) & (F.col("total") >= 3) & ((F.col("distance") == 0) | F.col("sub"))
    return best.withColumn("sure", sure)


@query("spelling_rank", f"WITH {_RANKED} SELECT word, suggestion, CAST(distance AS INT) AS distance, score, CAST(rank AS INT) AS rank, rank = 1 AND distance <= 1 AND total >= 3 AND (distance = 0 OR sub) AS sure FROM r WHERE rank <= 4")
def spelling_rank(t):
    """Words of the corpus closest to misspelt ones (here query words without their fourth letter),
    by distance with a free last letter, subsequence, first letter and frequency; whether the first is sure."""
    return _suggestions(t, kept(_vocabulary(t), "vocabulary")).select("word", "suggestion", "distance", "score", "rank", "sure")


@query("corrected_search", f"""WITH {_RANKED}, ok AS (SELECT word, suggestion FROM r WHERE rank = 1 AND distance <= 1 AND total >= 3 AND (distance = 0 OR sub)),
ask AS (SELECT q.w AS asked, coalesce(ok.suggestion, q.w) AS used FROM q LEFT JOIN ok ON ok.word = q.w WHERE q.w NOT IN (SELECT word FROM voc)),
x AS (SELECT DISTINCT doc_id, w FROM ({words_sql('documents', 'doc_id')}))
SELECT asked, used, asked <> used AS corrected, count(x.doc_id) AS docs, min(x.doc_id) AS first_doc FROM ask LEFT JOIN x ON x.w = ask.used GROUP BY ALL""")
def corrected_search(t):
    """Words that nothing has are asked again in their sure correction; documents found."""
    v = kept(_vocabulary(t), "vocabulary")
    ok = _suggestions(t, v).filter("sure").select(F.col("word").alias("asked"), "suggestion")
    unknown = _misspelt(t).withColumnRenamed("word", "asked").join(v.select(F.col("word").alias("asked")), "asked", "left_anti")
    ask = unknown.join(ok, "asked", "left").select("asked", F.coalesce("suggestion", "asked").alias("used"))
    x = t("documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), stemmed=False))).alias("used"))
    return ask.join(x, "used", "left").groupBy("asked", "used", (F.col("asked") != F.col("used")).alias("corrected")).agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("prefix_probe", f"""WITH {_VOC}, q AS (SELECT DISTINCT {_sound_sql('w')} AS k FROM ({words_sql('benchmark', 'item_id')}) WHERE length(w) >= 4), i AS (SELECT {_sound_sql('word')} AS k, sum(total) AS total FROM voc GROUP BY 1)
SELECT q.k AS probe, count(*) AS n_keys, CAST(sum(i.total) AS BIGINT) AS total FROM q JOIN i ON i.k = q.k OR (starts_with(i.k, q.k) AND length(i.k) - length(q.k) <= 3) OR (length(i.k) >= 5 AND starts_with(q.k, i.k) AND length(q.k) - length(i.k) <= 1) GROUP BY 1""")
def prefix_probe(t):
    """Index keys that begin with a query's key, or the other way round, within a few letters. The join is on the
    shortened keys, which are few for each word."""
    i = _vocabulary(t).groupBy(W.sound_key(F.col("word")).alias("k")).agg(F.sum("total").alias("total"))
    q = t("benchmark").select(F.explode(T.tokens(F.col("text"), stemmed=False)).alias("w")).filter(F.length("w") >= 4).select(W.sound_key(F.col("w")).alias("probe")).distinct()
    heads = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.substring(F.col("k"), F.lit(1), F.length("k") - s)), lambda x: F.length(x) > 0)
    longer = i.select("k", "total", F.explode(F.array_distinct(heads)).alias("probe")).join(q, "probe")
    shorter = q.select("probe", F.substring("probe", F.lit(1), F.length("probe") - 1).alias("k")).filter(F.length("k") >= 5).join(i, "k").select("k", "total", "probe")
    return longer.select("probe", "k", "total").union(shorter.select("probe", "k", "total")).distinct().groupBy("probe").agg(F.count("*").alias("n_keys"), F.sum("total").alias("total"))


@query("reference_parse", r"WITH c AS (SELECT c_custkey, 'see ' || (c_custkey % 130) || ':' || (c_custkey % 17 + 1) || CASE WHEN c_custkey % 3 = 0 THEN '-' || (c_custkey % 11 + 1) ELSE '' END || ' there' AS text FROM customer), p AS (SELECT c_custkey, TRY_CAST(regexp_extract(text, '(\d+) ?: ?(\d+)', 1) AS INT) AS g, TRY_CAST(regexp_extract(text, '(\d+) ?: ?(\d+)', 2) AS INT) AS a, TRY_CAST(regexp_extract(text, '(\d+) ?: ?(\d+) ?- ?(\d+)', 3) AS INT) AS b FROM c), n AS (SELECT n_nationkey + 1 AS g, 5 + n_nationkey % 7 AS most FROM nation) SELECT c_custkey, p.g AS grp, least(a, coalesce(b, a)) AS first, greatest(a, coalesce(b, a)) AS last, n.most IS NOT NULL AND greatest(a, coalesce(b, a)) <= n.most AND least(a, coalesce(b, a)) >= 1 AS valid FROM p LEFT JOIN n ON n.g = p.g")
def reference_parse(t):
    """References s:a-b out of texts, ends put in order, and whether the group has such places."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("see "), (k % 130).cast("string"), F.lit(":"), (k % 17 + 1).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("-"), (k % 11 + 1).cast("string"))).otherwise(""), F.lit(" there"))
    p = t("customer").select(k, W.reference(text).alias("r")).select("c_custkey", F.col("r.group").alias("grp"), "r.first", "r.last")
    groups = t("nation").select((F.col("n_nationkey") + 1).alias("grp"), (5 + F.col("n_nationkey") % 7).alias("most"))
    return p.join(groups, "grp", "left").select("c_custkey", "grp", "first", "last", (F.col("most").isNotNull() & (F.col("last") <= F.coalesce("most", F.lit(0))) & (F.col("first") >= 1)).alias("valid"))


_PACK = "list_reduce(list_prepend({first}, list_transform({ws}, lambda w: [w])), lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[len(acc)]) + 1 + length(x[1]) <= {most} THEN list_append(acc[:len(acc) - 1], acc[len(acc)] || ' ' || x[1]) ELSE list_append(acc, x[1]) END)"


@query("speech_chunks", f"WITH p AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM conversations), c AS (SELECT conv_id, turn, {_PACK.format(first='CAST([] AS VARCHAR[])', ws='ws', most=80)} AS chunks FROM p) SELECT conv_id, turn, i AS pos, c AS chunk FROM (SELECT conv_id, turn, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM c)")
def speech_chunks(t):
    """Texts packed greedily by words into chunks under a limit."""
    words = F.filter(F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " "), lambda w: w != "")
    d = t("conversations").select("conv_id", "turn", F.posexplode(W.packed(words, 80)).alias("p", "chunk"))
    return d.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "chunk")


_UNIT = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(ps, lambda w: [w])), lambda acc, x: CASE WHEN len(acc) > 0 AND (length(x[1]) < 30 OR regexp_matches(x[1], '^[a-z(,;:]') OR length(acc[len(acc)]) < 30) AND length(acc[len(acc)]) + 1 + length(x[1]) <= 600 THEN list_append(acc[:len(acc) - 1], acc[len(acc)] || ' ' || x[1]) ELSE list_append(acc, x[1]) END)"


@query("passage_units", f"WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?;]+[.!?;]*'), lambda s: trim(s)), lambda s: length(s) >= 2) AS ps FROM conversations), u AS (SELECT conv_id, turn, {_UNIT} AS us FROM p) SELECT conv_id, turn, i AS pos, u AS unit FROM (SELECT conv_id, turn, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM u) WHERE length(u) BETWEEN 12 AND 600")
def passage_units(t):
    """Sentences merged to units by length and continuation, within bounds."""
    d = t("conversations").select("conv_id", "turn", F.posexplode(W.pieces(F.col("text"), 600)).alias("p", "unit")).filter(F.length("unit").between(12, 600))
    return d.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "unit")


@query("candidate_snippet", "SELECT p_partkey, head || CASE WHEN room > 10 THEN ' (' || substr(note, 1, CAST(room AS INT)) || ')' ELSE '' END AS snippet FROM (SELECT p_partkey, substr(p_name || ' ' || p_brand, 1, 12) AS head, 40 - length(substr(p_name || ' ' || p_brand, 1, 12)) - 3 AS room, p_type || ' of size ' || p_size || ' at ' || CAST(floor(p_retailprice) AS BIGINT) AS note FROM part)")
def candidate_snippet(t):
    """A head under one limit, and a note in what is left of a total."""
    head = F.substring(F.concat_ws(" ", "p_name", "p_brand"), 1, 12)
    room = 40 - F.length(head) - 3
    note = F.concat(F.col("p_type"), F.lit(" of size "), F.col("p_size").cast("string"), F.lit(" at "), F.floor("p_retailprice").cast("string"))
    return t("part").select("p_partkey", F.concat(head, F.when(room > 10, F.concat(F.lit(" ("), F.substring(note, F.lit(1), room), F.lit(")"))).otherwise("")).alias("snippet"))


@query("text_clip", "SELECT page_id, substr(regexp_replace(html, '[\\x00-\\x1f\\x7f]', ' ', 'g'), 1, 120) AS clipped FROM pages")
def text_clip(t):
    """Control characters out, cut to a limit."""
    return t("pages").select("page_id", T.clip(F.col("html"), 120).alias("clipped"))


_LIST = "CASE WHEN c_custkey % 3 = 0 THEN '[' || c_custkey || ',' || c_nationkey || ']' WHEN c_custkey % 3 = 1 THEN c_custkey || ', ' || c_nationkey ELSE '[' || c_custkey || ',' END"


@query("list_parse", f"WITH s AS (SELECT c_custkey, {_LIST} AS s FROM customer) SELECT c_custkey, CASE WHEN json_valid(s) AND s LIKE '[%' THEN list_transform(CAST(s AS JSON)::JSON[], lambda x: CAST(x AS VARCHAR)) ELSE list_filter(list_transform(string_split(regexp_replace(s, '[\\[\\]]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') END AS items FROM s")
def list_parse(t):
    """A list written as a string: as JSON, else split at commas."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("["), k.cast("string"), F.lit(","), F.col("c_nationkey").cast("string"), F.lit("]"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(", "), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit(",")))
    split = F.filter(F.transform(F.split(F.regexp_replace(text, "[\\[\\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return t("customer").select("c_custkey", F.coalesce(F.from_json(text, "array<string>"), split).alias("items"))


_PLAIN = f"{LATIN % DIG % 'text'}"


@query("folded_match", f"WITH w AS (SELECT conv_id, turn, text, unnest(regexp_extract_all(text, '\\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM conversations), o AS (SELECT conv_id, turn, i, w, {(LATIN % DIG % 'w')} AS f FROM w) SELECT conv_id, turn, i AS pos, w AS original FROM o WHERE f IN ('le', 'en', 'a', 'un', 'und', 'the')")
def folded_match(t):
    """A search on folded words that returns the original ones and their places."""
    d = t("conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0))).alias("p", "original"))
    return d.filter(T.latin(F.col("original")).isin("le", "en", "a", "un", "und", "the")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "original")


@query("surface_forms", f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM documents), o AS (SELECT doc_id, i, w, {(LATIN % DIG % 'w')} AS f FROM w) SELECT f AS form, first(w ORDER BY doc_id, i) AS surface, count(*) AS n FROM o WHERE length(f) >= 3 GROUP BY f")
def surface_forms(t):
    """How a folded form is written where it comes first."""
    d = t("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0))).alias("p", "w")).withColumn("form", T.latin(F.col("w"))).filter(F.length("form") >= 3)
    return d.groupBy("form").agg(F.min_by("w", F.struct("doc_id", "p")).alias("surface"), F.count("*").alias("n"))


@query("marked_quotes", r"""SELECT page_id, regexp_replace(html, 'href="([^"]*)"', '<<\1>>', 'g') AS marked, len(regexp_extract_all(html, 'href="[^"]*"')) AS n FROM pages""")
def marked_quotes(t):
    """Embedded quotations replaced by markers that keep what they held."""
    return t("pages").select("page_id", F.regexp_replace("html", 'href="([^"]*)"', "<<$1>>").alias("marked"), F.regexp_count("html", F.lit('href="[^"]*"')).cast("long").alias("n"))


@query("transcript_repair", f"""WITH {_VOC}, w AS (SELECT item_id, i, CASE WHEN i % 5 = 0 THEN w || 'e' WHEN i % 7 = 0 THEN 'an' || w ELSE w END AS w FROM ({words_sql('benchmark', 'item_id')})),
f AS (SELECT item_id, i, w.w, coalesce(a.total, 0) AS own, b.total AS cut, c.total AS bare FROM w LEFT JOIN voc a ON a.word = w.w LEFT JOIN voc b ON b.word = substr(w.w, 1, length(w.w) - 1) AND w.w LIKE '%e' LEFT JOIN voc c ON c.word = substr(w.w, 3) AND w.w LIKE 'an%' AND length(w.w) >= 5),
r AS (SELECT item_id, i, CASE WHEN own > 0 THEN w WHEN cut IS NOT NULL THEN substr(w, 1, length(w) - 1) WHEN bare IS NOT NULL THEN 'an ' || substr(w, 3) ELSE w END AS w, own = 0 AND (cut IS NOT NULL OR bare IS NOT NULL) AS fixed FROM f)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS repaired, count(*) FILTER (WHERE fixed) AS n_fixed FROM r GROUP BY item_id""")
def transcript_repair(t):
    """Words that the corpus does not know are repaired by one that it does: the last letter off, or a glued
    particle split; the text is put together again in order."""
    w = t("benchmark").select("item_id", F.posexplode(F.split(T.latin(F.coalesce("text", F.lit(""))), " ")).alias("p", "w")).filter((F.length("w") >= 2) & ~F.col("w").isin(*T.STOP))
    i = F.col("p") + 1
    w = w.select("item_id", i.alias("i"), F.when(i % 5 == 0, F.concat("w", F.lit("e"))).when(i % 7 == 0, F.concat(F.lit("an"), "w")).otherwise(F.col("w")).alias("w"))
    tries = w.withColumn("cut", F.when(F.col("w").endswith("e"), F.substring("w", F.lit(1), F.length("w") - 1))).withColumn("bare", F.when(F.col("w").startswith("an") & (F.length("w") >= 5), F.substring("w", F.lit(3), F.length("w"))))
    known = _vocabulary(t).select("word").withColumn("there", F.lit(True))
    for c in ("w", "cut", "bare"):
        tries = tries.join(known.select(F.col("word").alias(c), F.col("there").alias(f"{c}_known")), c, "left")
    fixed = F.when(F.col("w_known").isNotNull(), F.lit(None)).when(F.col("cut_known"), F.col("cut")).when(F.col("bare_known"), F.concat(F.lit("an "), "bare"))
    r = tries.withColumn("fixed", fixed)
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("fixed", "w").alias("w")))), lambda x: x["w"])
    return r.groupBy("item_id").agg(F.array_join(words, " ").alias("repaired"), F.count("fixed").alias("n_fixed"))


@query("word_alignment", f"""WITH RECURSIVE t AS (SELECT x.conv_id, x.turn, string_split({LATIN % "coalesce(x.text, '')"}, ' ') AS a, string_split({LATIN % "coalesce(y.text, '')"}, ' ') AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
s AS (SELECT conv_id, turn, a, b, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS place FROM t
UNION ALL SELECT conv_id, turn, a, b, i + 1, CASE WHEN f.d <= 0.6::DOUBLE THEN f.j + 1 ELSE k END, CASE WHEN f.d <= 0.6::DOUBLE THEN f.j END FROM
(SELECT *, list_sort(list_transform(range(k, least(k + 4, len(b) + 1)), lambda j: {{'d': levenshtein(a[i + 1], b[j]) / CAST(greatest(length(a[i + 1]), 1) AS DOUBLE), 'j': j}}))[1] AS f FROM s WHERE i < len(a)))
SELECT conv_id, turn, CAST(i AS INT) AS i, a[i] AS word, CAST(place AS INT) AS place FROM s WHERE i > 0""")
def word_alignment(t):
    """The words of a turn aligned in order with those of the next, each with the closest of the next four."""
    c = t("conversations").select("conv_id", "turn", F.split(T.latin(F.coalesce("text", F.lit(""))), " ").alias("a"))
    both = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    each = both.select("conv_id", "turn", F.posexplode(F.arrays_zip("a", W.aligned(F.col("a"), F.col("b")).alias("place"))).alias("p", "x"))
    return each.select("conv_id", "turn", (F.col("p") + 1).alias("i"), F.col("x.a").alias("word"), F.col("x.place").alias("place"))
