"""Queries of what was heard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spoken, verify
from .registry import query

_W = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("speech_scores", f"""WITH b AS (SELECT item_id, {_W.format('text')} AS ws FROM benchmark),
h AS (SELECT item_id, ws[1:6] AS keys, list_filter(list_transform(ws, lambda w, i: CASE WHEN i % 7 = 0 THEN '' WHEN i % 3 = 1 THEN 'al' || w WHEN i % 5 = 2 THEN 'xyz' || w ELSE w END), lambda w: w <> '') AS heard FROM b),
m AS (SELECT item_id, len(heard) AS n, len(list_filter(keys, lambda k: len(list_filter(heard, lambda w: w = k OR (suffix(w, k) AND length(w) <= length(k) + 2))) = 0)) AS missed FROM h)
SELECT item_id % 3 AS engine, count(*) AS n, count(*) FILTER (WHERE missed = 0) AS right_ones, count(*) FILTER (WHERE n = 0) AS empty_ones, CAST(sum(missed) AS BIGINT) AS missed, round(avg(n), 4) AS mean_words FROM m GROUP BY 1""")
def speech_scores(t):
    """Of spoken items those whose every key word was heard, also as the end of a word that is two letters longer; by
    engine. What was heard is made from the text: a third of its words gets a short prefix, others a long one, or are lost."""
    b = t("benchmark").select("item_id", verify.words(F.col("text")).alias("ws"))
    said = F.transform("ws", lambda w, i: F.when(i % 7 == 6, "").when(i % 3 == 0, F.concat(F.lit("al"), w)).when(i % 5 == 1, F.concat(F.lit("xyz"), w)).otherwise(w))
    h = b.select("item_id", F.slice("ws", 1, 6).alias("keys"), F.filter(said, lambda w: w != "").alias("heard"))
    m = h.select((F.col("item_id") % 3).alias("engine"), F.size("heard").alias("n"), F.size(spoken.missed(F.col("keys"), F.col("heard"))).alias("missed"))
    return m.groupBy("engine").agg(F.count("*").alias("_n"), F.count_if(F.col("missed") == 0).alias("right_ones"), F.count_if(F.col("n") == 0).alias("empty_ones"), F.sum("missed").cast("long").alias("missed"), F.round(F.avg("n"), 4).alias("mean_words")).withColumnRenamed("_n", "n")


_GHOSTS = ("^[^\\p{L}]*(the|la|der|et)[^\\p{L}]*$", "^[^\\p{L}]*$")


@query("transcripts", f"""WITH s AS (SELECT conv_id, turn, text, -(length(text) % 16) / 10.0::DOUBLE AS lp, (length(text) % 10) / 10.0::DOUBLE AS ns FROM conversations),
k AS (SELECT conv_id, trim(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE NOT coalesce((ns > 0.6 AND lp < -0.7) OR lp < -1.2, false)), ''), '\\s+', ' ', 'g')) AS text, max(CASE WHEN turn = 1 THEN text END) AS prompt FROM s GROUP BY conv_id)
SELECT conv_id, CASE WHEN (len(string_split_regex(text, '\\s+')) >= 4 AND coalesce(contains(prompt, regexp_replace(text, '[.,:;!?]+$', '')), false)) OR regexp_matches(text, '{_GHOSTS[0]}') OR regexp_matches(text, '{_GHOSTS[1]}') THEN '' ELSE substr(text, 1, 500) END AS heard FROM k""")
def transcripts(t):
    """Each conversation as a transcript of segments, filtered by their probabilities (which their lengths stand for),
    ghost phrases, and an echo of its second turn."""
    size = F.length("text")
    s = t("conversations").select("conv_id", "turn", F.struct("turn", F.col("text").alias("text"), (-(size % 16) / 10.0).alias("avg_logprob"), ((size % 10) / 10.0).alias("no_speech_prob")).alias("s"))
    k = s.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("all"), F.max(F.when(F.col("turn") == 1, F.col("s.text"))).alias("prompt"))  # a conversation's turns
    return k.select("conv_id", spoken.transcript(F.col("all"), F.col("prompt"), _GHOSTS).alias("heard"))
