"""Queries over texts: normalising, tokens, sentences, HTML, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranks, rules
from .registry import query

DIG = f"translate(%s, '{T.DIGITS[0]}', '{T.DIGITS[1]}')"
LATIN = f"trim(regexp_replace(translate(lower(%s), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[^a-z0-9]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOP)
_PLURAL = """CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN substr({w}, 1, length({w}) - 3) || 'y'
 WHEN length({w}) > 4 AND {w} LIKE '%es' THEN substr({w}, 1, length({w}) - 2)
 WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN substr({w}, 1, length({w}) - 1) ELSE {w} END"""
_STEM = """CASE WHEN length(p) > 5 AND p LIKE '%ing' THEN CASE WHEN substr(p, length(p) - 3, 1) = substr(p, length(p) - 4, 1)
 THEN substr(p, 1, length(p) - 4) ELSE substr(p, 1, length(p) - 3) END ELSE p END"""


def words_sql(table: str, key: str, text: str = "text", extra: str = "") -> str:
    """CTE body: (key, w, place) of the words that tokens() keeps before stemming."""
    return f"""SELECT {key}{extra}, w, i FROM (SELECT {key}{extra}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
 (SELECT {key}{extra}, string_split({LATIN % DIG % f"coalesce({text}, '')"}, ' ') AS ws FROM {table})) WHERE length(w) >= 2 AND w NOT IN ({_STOP})"""


def stems_sql(table: str, key: str, text: str = "text") -> str:
    """CTE body: (key, token, i) of tokens()."""
    return f"SELECT {key}, {_STEM} AS token, i FROM (SELECT *, {_PLURAL.format(w='w')} AS p FROM ({words_sql(table, key, text)}))"


@query("text_normalize", f"SELECT doc_id, {LATIN % DIG % 'text'} AS plain, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS squeezed FROM documents")
def text_normalize(t):
    """Digits folded, Latin normal form, near-equality key."""
    return t("documents").select("doc_id", T.latin(F.col("text")).alias("plain"), T.squeeze(F.col("text")).alias("squeezed"))


@query("rule_normalize", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[!?.,;:]', ' ', 'g'), '[0-9]+', '#', 'g'), '[ \\n\\t]+', ' ', 'g')) AS plain FROM documents")
def rule_normalize(t):
    """T2, T4 as a rule table: a normaliser from an ordered rule table."""
    return t("documents").select("doc_id", T.by_rules(F.col("text"), [("[!?.,;:]", " "), ("[0-9]+", "#"), ("[ \\n\\t]+", " ")]).alias("plain"))


@query("token_counts", f"WITH s AS ({stems_sql('documents', 'doc_id')}) SELECT d.doc_id, count(s.token) AS n_tokens, count(DISTINCT s.token) AS n_distinct FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id")
def token_counts(t):
    """Stemmed tokens of each document."""
    x = T.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct"))


@query("script_detect", "SELECT page_id, CASE WHEN regexp_matches(url, '[\\x{0600}-\\x{06FF}]') THEN 'arabic' WHEN regexp_matches(url, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(url, '\\p{L}') THEN 'other' ELSE 'none' END AS script FROM pages")
def script_detect(t):
    """Language by script, with a default."""
    return t("pages").select("page_id", T.script(F.col("url")).alias("script"))


@query("sentence_units", "SELECT doc_id, i AS pos, s AS sentence FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: length(trim(s)) >= 12) AS x FROM documents))")
def sentence_units(t):
    """Sentences as exact substrings, with their place."""
    d = t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence"))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "sentence")


@query("excerpt_cut", "WITH s AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: length(trim(s)) >= 12) AS x FROM documents))), r AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s) SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM r WHERE upto <= 600 GROUP BY doc_id")
def excerpt_cut(t):
    """Whole sentences under a budget of characters, by a running sum."""
    s = t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    upto = F.sum(F.length("s")).over(Window.partitionBy("doc_id").orderBy("i"))
    return s.withColumn("upto", upto).filter("upto <= 600").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("truncate_words", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), '\\s+\\S*\\z', '') || '…' END AS head FROM documents")
def truncate_words(t):
    """Cut at a word's end with an ellipsis."""
    return t("documents").select("doc_id", T.truncate(F.col("text"), 200).alias("head"))


_STRIP = "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"


@query("html_strip", f"SELECT page_id, trim(regexp_replace({_STRIP}, '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM pages")
def html_strip(t):
    """Text of HTML."""
    return t("pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("link_extract", "SELECT page_id, i AS pos, l AS href FROM (SELECT page_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS x FROM pages))")
def link_extract(t):
    """T22 in part: records from HTML."""
    d = t("pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("p", "href"))
    return d.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "href")


LINES_SQL = f"SELECT page_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '{T.INLINE}', ' ', 'g'), '{T.LINE}') AS ls FROM pages)"
LINE_TEXT_SQL = r"trim(regexp_replace(regexp_replace(s, '^<[^>]*>', ''), '[ \t\r\n]+', ' ', 'g'))"


@query("html_sections", f"WITH x AS ({LINES_SQL}), y AS (SELECT *, CASE WHEN s LIKE '<h%' THEN 1 ELSE 0 END AS head FROM x) SELECT page_id, i AS pos, head = 1 AS is_heading, {LINE_TEXT_SQL} AS line, CAST(sum(head) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS section FROM y")
def html_sections(t):
    """Lines with a heading mark and their whole text; a section runs from one heading to the next."""
    d = t("pages").select("page_id", F.posexplode(T.lines(F.col("html"))).alias("p", "s")).withColumn("head", F.col("s").startswith("<h").cast("long"))
    section = F.sum("head").over(Window.partitionBy("page_id").orderBy("p"))
    return d.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), (F.col("head") == 1).alias("is_heading"), T.line_text(F.col("s")).alias("line"), section.alias("section"))


@query("url_hosts", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS n_urls FROM pages GROUP BY 1")
def url_hosts(t):
    """Host inventory."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t("pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_distinct(F.regexp_replace("url", "[?#].*$", "")).alias("n_urls"))


@query("content_digest", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def content_digest(t):
    """Digest and size of each content."""
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(regexp_extract('noise ' || props || ' tail', '\\{[\\s\\S]*\\}'), '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    """A JSON object cut out of noisy text and parsed."""
    noisy = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    return t("events").select("event_id", F.get_json_object(T.json_in(noisy), "$.k").cast("long").alias("k"))


@query("token_offsets", "SELECT conv_id, turn, i AS pos, w AS word, CAST(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(w) - 1 AS BIGINT) AS start FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations)")
def token_offsets(t):
    """Code-point offsets of words, by a running sum."""
    d = t("conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "word"))
    upto = F.sum(F.length("word") + 1).over(Window.partitionBy("conv_id", "turn").orderBy("p"))
    return d.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), "word", (upto - F.length("word") - 1).cast("long").alias("start"))


@query("letter_counts", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(text) AS chars FROM documents")
def letter_counts(t):
    """Characters by class."""
    n = lambda p: F.length(F.regexp_replace("text", p, "")).cast("long")
    return t("documents").select("doc_id", n("[^A-Za-z]").alias("letters"), n("[^0-9]").alias("digits"), F.length("text").cast("long").alias("chars"))


@query("spoken_clean", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '(^| )(uh+|um+|er|the|de)( |\\z)', ' ', 'g'), ' +', ' ', 'g')) AS kept, regexp_matches(lower(text), '(^| )(uh+|um+|er|the|de)( |\\z)') AS changed FROM conversations")
def spoken_clean(t):
    """Fillers out of spoken text, and whether any were there."""
    filler = "(^| )(uh+|um+|er|the|de)( |\\z)"
    low = F.lower("text")
    return t("conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace(low, filler, " "), " +", " ")).alias("kept"), low.rlike(filler).alias("changed"))


SPOKEN = {"filler": ["the", "le", "der"], "polite": ["la", "die"], "q": ["et", "and", "und"], "want": ["une", "an"], "ask": ["dans", "with"], "frame_verb": ["est", "is", "re"], "subject": ["it", "en", "in"], "prep": ["of", "on", "ou"], "lone": ["at", "eux"]}
PHRASES = {"avec un": "ask", "for that": "want"}


def _spoken_sql() -> str:
    own = lambda *names: "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(w) for w in SPOKEN[n])}) THEN '{n}'" for n in names) + " END"
    has = lambda name: f"w IN ({', '.join(repr(w) for w in SPOKEN[name])})"
    pair = lambda x: f"CASE {x} " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in PHRASES.items()) + " END"
    order = "PARTITION BY conv_id, turn ORDER BY i"
    past, rest = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"({order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    run = lambda f, test, over, value="coalesce(k, '')": f"{f}(CASE WHEN NOT ({test}) THEN {value} END IGNORE NULLS) OVER {over}"
    base = "conv_id, turn, i, w"
    return f"""WITH a0 AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, string_split({LATIN % "coalesce(text, '')"}, ' ') AS ws FROM conversations)),
a1 AS (SELECT {base}, {own("filler", "polite")} AS k FROM a0),
a2 AS (SELECT {base}, coalesce(k, CASE WHEN k IS NULL THEN coalesce({pair("l || ' ' || w")}, {pair("w || ' ' || n")}) END) AS k FROM (SELECT *, lag(w) OVER v AS l, lead(w) OVER v AS n FROM a1 WINDOW v AS (PARTITION BY conv_id, turn, k IS NULL ORDER BY i))),
a3 AS (SELECT {base}, coalesce(k, {own("want", "ask")}, CASE WHEN {has("q")} AND s = 0 THEN 'q' END) AS k FROM (SELECT *, count(*) FILTER (WHERE k IS NULL AND {own("want", "ask", "q")} IS NULL) OVER {past} AS s FROM a2)),
a4 AS (SELECT {base}, k, coalesce(k IS NULL AND {has("frame_verb")} AND (coalesce(b IN ('q', 'polite', 'filler', 'want', 'ask'), false) OR coalesce(n IN ('q', 'ask'), false) OR coalesce(s, false)), false) AS f FROM (SELECT *, lag(k) OVER v AS b, lead(k) OVER v AS n, lead({has("subject")}) OVER v AS s FROM a3 WINDOW v AS ({order}))),
a5 AS (SELECT {base}, CASE WHEN f OR (k IS NULL AND {has("subject")} AND coalesce(r, false)) THEN 'frame' ELSE k END AS k FROM (SELECT *, {run("last", f"k IS NULL AND {has('subject')} AND NOT f", past, "f")} AS r FROM a4)),
a6 AS (SELECT {base}, coalesce(k, CASE WHEN {has("subject")} AND r IN ('frame', 'q') THEN 'frame' END) AS k FROM (SELECT *, {run("first", f"k IS NULL AND {has('subject')}", rest)} AS r FROM a5)),
a7 AS (SELECT {base}, coalesce(k, CASE WHEN {has("prep")} AND r <> '' AND n IS NOT NULL THEN 'frame' END) AS k FROM (SELECT *, {run("last", f"k IS NULL AND {has('prep')}", past)} AS r, lead(i) OVER ({order}) AS n FROM a6)),
a8 AS (SELECT {base}, coalesce(k, CASE WHEN {has("lone")} AND r <> '' THEN r END) AS k FROM (SELECT *, {run("last", f"k IS NULL AND {has('lone')}", past)} AS r FROM a7))
SELECT conv_id, turn, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE k IS NULL), '') AS kept, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS kinds, count(k) AS n_removed FROM a8 GROUP BY ALL"""


@query("spoken_passes", _spoken_sql())
def spoken_passes(t):
    """Spoken questions cleaned in seven passes: what stays, and why words were left out."""
    w = t("conversations").select("conv_id", "turn", F.posexplode(F.split(T.latin(F.coalesce("text", F.lit(""))), " ")).alias("i", "w"))
    r = rules.spoken(w, ["conv_id", "turn"], "i", "w", SPOKEN, PHRASES)
    stays = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.struct("i", "w")))), lambda x: x["w"])
    return r.groupBy("conv_id", "turn").agg(F.array_join(stays, " ").alias("kept"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("kind").alias("n_removed"))


_W = words_sql("documents", "doc_id", extra=", source")


@query("group_text_stats", f"WITH w AS ({_W}), d AS (SELECT source, doc_id, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY ALL) SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words, CAST(sum(c) AS BIGINT) AS letters, max(n) AS longest, min(n) AS shortest, first(doc_id ORDER BY n DESC, doc_id) AS longest_doc FROM d GROUP BY source")
def group_text_stats(t):
    """Words and letters of each group, the longest and shortest passage, ties to the first."""
    w = T.tokens(F.col("text"), stemmed=False)
    d = t("documents").select("source", "doc_id", F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("c")).filter("n > 0")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.sum("c").alias("letters"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("longest_doc"))


@query("word_stats", f"WITH w AS ({_W}) SELECT w AS word, count(*) AS total, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS groups, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM w GROUP BY w")
def word_stats(t):
    """Occurrences, passages, groups, first and last of every word."""
    w = t("documents").select("doc_id", "source", F.explode(T.tokens(F.col("text"), stemmed=False)).alias("word"))
    of_doc = w.groupBy("word", "doc_id").agg(F.count("*").alias("n"), F.first("source").alias("source"))  # a document has one source
    of_group = of_doc.groupBy("word", "source").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return of_group.groupBy("word").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("source").alias("groups"), F.min("least").alias("first_doc"), F.max("most").alias("last_doc"))


@query("top_words", f"WITH w AS ({_W}), c AS (SELECT source, w AS word, count(*) AS n FROM w GROUP BY ALL) SELECT source, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10")
def top_words(t):
    """The ten most frequent words of each group."""
    w = t("documents").select("source", F.explode(T.tokens(F.col("text"), stemmed=False)).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return w.withColumn("rank", rank).filter("rank <= 10")


@query("passage_rank", "SELECT doc_id, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS rank, round(n_chars / sum(n_chars) OVER (PARTITION BY source), 6) AS share FROM documents")
def passage_rank(t):
    """Rank by length in the group, share of the group."""
    d = t("documents").select("doc_id", "source", "n_chars")
    of_value = ranks.ranked(d, ["source"], "n_chars").select(F.col("source").alias("s"), F.col("n_chars").alias("v"), "rank")
    whole = d.groupBy(F.col("source").alias("w")).agg(F.sum("n_chars").alias("all"))
    placed = d.join(of_value, F.col("source").eqNullSafe(F.col("s")) & F.col("n_chars").eqNullSafe(F.col("v"))).join(whole, F.col("source").eqNullSafe(F.col("w")))
    return placed.select("doc_id", "rank", F.round(F.col("n_chars") / F.col("all"), 6).alias("share"))


@query("corpus_totals", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_totals(t):
    """Totals by language and group, with a roll-up."""
    return t("documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("question_rules", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\?') THEN 'question' WHEN regexp_matches(text, '[0-9]{2,}') THEN 'number' WHEN length(text) < 60 THEN 'short' WHEN role = 'system' THEN 'system' END AS kind FROM conversations")
def question_rules(t):
    """Ordered rules, the first that matches decides."""
    from ..operators.rules import first_match

    rules = [(F.col("text").rlike("\\?"), "question"), (F.col("text").rlike("[0-9]{2,}"), "number"), (F.length("text") < 60, "short"), (F.col("role") == "system", "system")]
    return t("conversations").select("conv_id", "turn", first_match(rules).alias("kind"))
