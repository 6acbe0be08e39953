"""Queries of closed lists: answers chosen under rules, contained texts refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection
from .registry import query
from .retrieval_queries import scanned_best

_K = "regexp_replace(lower(s), '[^\\p{L}\\p{N}]', '', 'g')"


@query("contained_refused", f"""WITH RECURSIVE c AS (SELECT role, conv_id, turn, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), 1) - 1 AS pos FROM conversations),
r AS (SELECT role, conv_id, turn, pos, {_K} AS k, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, pos) AS n FROM c),
g AS (SELECT role, n, conv_id, turn, pos, [struct_pack(k := k, n := n)] AS taken, NULL::BIGINT AS hit FROM r WHERE n = 1
  UNION ALL SELECT role, n, conv_id, turn, pos, CASE WHEN hit IS NULL THEN list_append(taken, struct_pack(k := k, n := n)) ELSE taken END, hit FROM (
    SELECT r.*, g.taken, list_filter(g.taken, lambda x: x.k = r.k OR (length(x.k) > 40 AND length(r.k) > 40 AND (contains(x.k, r.k) OR contains(r.k, x.k))))[1].n AS hit FROM g JOIN r ON g.role = r.role AND r.n = g.n + 1))
SELECT g.role, g.conv_id, g.turn, CAST(g.pos AS INT) AS pos, h.conv_id AS by_conv, h.turn AS by_turn, CAST(h.pos AS INT) AS by_pos FROM g LEFT JOIN r h ON h.role = g.role AND h.n = g.hit""")
def contained_refused(t):
    """V5: each role's sentences in order; one that equals an accepted one, holds it or lies in it, is refused."""
    s = t("conversations").select("role", "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?\\n]+[.!?]*"), F.lit(0))).alias("pos", "text"))
    rows = s.select("role", "pos", "conv_id", "turn", F.struct("conv_id", "turn", "pos").alias("at"), "text")
    return selection.without_contained(rows, "role", "at", "text").select("role", "conv_id", "turn", "pos", F.col("refused_by.conv_id").alias("by_conv"), F.col("refused_by.turn").alias("by_turn"), F.col("refused_by.pos").alias("by_pos"))


def closed_list(t):
    """For each benchmark text its closed list (V1): of the eight best documents the first sentence of at most 400 letters
    as text (of four at most) and up to four more as notes, of the next four two sentences each as reports; for texts that
    ask for a ruling (their documents say so) three documents as answers, their first sentence being the question."""
    best = scanned_best(t, 12).select("item_id", "doc_id", "rank", "coverage")
    ruling = t("benchmark").select("item_id", F.col("text").rlike("(?i)\\b(not|never|must|der|la)\\b").alias("ruling"), F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    docs = t("documents").select("doc_id", "source", F.slice(T.sentences(F.col("text")), 1, 9).alias("units"))
    rows = best.join(docs, "doc_id").join(ruling, "item_id").select("item_id", "doc_id", "rank", "source", "ruling", "asked", "coverage", F.posexplode("units").alias("n", "text"))
    rows = rows.withColumn("text", F.trim("text")).withColumn("size", F.length("text"))
    answer = F.col("ruling") & (F.col("rank") <= 3)
    text = ~F.col("ruling") & (F.col("rank") <= 4) & (F.col("n") == 0) & (F.col("size") <= 400)
    note = ~F.col("ruling") & (F.col("rank") <= 8) & F.col("n").between(1, 4) & (F.col("size") <= 600)
    report = ~F.col("ruling") & (F.col("rank") > 8) & (F.col("n") < 2)
    kind = F.when(answer, "answer").when(text, "text").when(note, "note").when(report, "report")
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    return rows.select(
        "item_id", (F.col("rank") * 100 + F.col("n")).alias("place"), F.concat_ws("#", F.upper(F.substring("kind", 1, 1)), "doc_id", "n").alias("sid"), "kind", F.col("doc_id").cast("string").alias("ref"),
        F.when(F.col("kind") == "answer", F.when(F.col("n") == 0, "question").otherwise("answer")).alias("part"), "n", "text", "ruling", "asked",
        (F.col("coverage") >= 0.5).alias("direct"), (F.col("source") == "src1").alias("lead"), (F.col("source") == "src2").alias("sensitive"), F.col("text").rlike("\\d").alias("harsh"),
    )


@query("answer_selection")
def answer_selection(t):
    """V4, V1: answers from the closed lists under all rules. The asked words stand for the concepts, and the list's items
    that hold such a word, in order, for the model's choices; digits mark harsh texts, sources the sensitive and leading."""
    listed = closed_list(t)
    words = F.array_distinct(T.tokens(F.col("text")))
    shares = F.size(F.array_intersect(words, "asked")) > 0
    gentle, off_sense, balanced = F.array_contains("asked", "the"), ~shares & (F.size("asked") > 8), F.size("asked") % 5 == 0
    rule = selection.barred(F.col("kind"), F.col("ruling"), F.col("direct"), shares, F.col("harsh"), gentle, F.col("sensitive") & balanced, off_sense, F.col("lead"))
    listed = listed.withColumn("harsh", F.col("harsh") & gentle).withColumn("balanced", balanced).withColumn("barred", rule)
    concepts = t("benchmark").select("item_id", F.posexplode(F.slice(F.array_distinct(T.tokens(F.col("text"))), 1, 5)).alias("point", "concept"))
    choices = listed.select("item_id", "sid", F.col("place").alias("pick"), F.explode(words).alias("concept")).join(concepts, ["item_id", "concept"])
    return selection.answers(choices, listed, "item_id")
