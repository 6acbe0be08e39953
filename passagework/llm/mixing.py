"""Operator 1: mixing sources to target weights. DataFrame functions only.

Every document gets a hash-random key. Within a source the keys are sorted in ranges (one range per leading digits of
the key, so a hot source is spread evenly over many tasks); ranges and rows get distributed prefix sums of their word
counts, and the mix is cut where a source's sum reaches its budget, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, beside, materialize, table

WEIGHTS, SHARE, MOST, SEED, DIGITS = (3, 1, 2), 1.5, 2.0, "mix-1", 3


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target): share of all sizes dealt by weight, none above most times its size.

    What sources at their cap leave goes to the others by weight until none is above: that is one common level per unit
    of weight, found at the first source (by size per weight) that stays below its cap. One row per source takes part.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    n, by_name = len(weights), Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "source_key")
    per = (
        per.withColumn("goal", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("weight_from"))
    )
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    per = per.withColumn("at", level)
    return per.select("source_key", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, digits: int = DIGITS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    taken counts the words that the mix takes, whole epochs first, then whole documents in key order up to the budget
    floor(target), the last one in part; so a source's taken words are its budget exactly. Null text has size 0; null
    source is a source of its own, ordered last; a null doc_id has the key of the empty string; rows with equal doc_id
    are ordered by size. Empty input gives an empty result; other columns are ignored.
    """
    named = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
    )
    sizes = materialize(named.withColumn("range", F.substring("key", 1, digits)), "mix")
    ranges = sizes.groupBy("source_key", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    ranges = ranges.join(source_targets(sizes, weights, share, most), "source_key")
    placed = sizes.join(ranges, ["source_key", "range"])
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken in part comes whole, one taken not at all goes.

    Rows that share a doc_id come as often as the one of them that the mix takes most.
    """
    times = mix_sources(docs).groupBy("doc_id").agg(F.max(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int").alias("times"))
    joined = beside(docs, id=F.col("doc_id")).join(times, F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


SQL = {
    "op1_mix_sources": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM per),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM named),
summed AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS goal,
    coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cap_before,
    CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_from FROM capped),
levels AS (SELECT *, (goal - cap_before) / weight_from AS level FROM summed),
lowest AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS mark FROM levels),
targets AS (SELECT source, source_size, CASE WHEN mark IS NULL THEN cap ELSE least(cap, mark * weight) END AS target FROM lowest),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS n FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(n * size + least(size, greatest(0, budget - n * source_size - start)) AS BIGINT) AS taken FROM whole
"""
}
