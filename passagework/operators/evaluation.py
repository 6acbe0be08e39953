"""Evaluation of rankings and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def rank_metrics(run: DataFrame, judged: DataFrame, by: str, key: str, depth: int = 10) -> DataFrame:
    """(by, hit, recall, reciprocal_rank, average_precision): run (by, key, rank from 1), judged (by, key). Questions
    without results count as 0."""
    relevant = judged.select(by, key).distinct()
    hits = run.filter(F.col("rank") <= depth).join(relevant, [by, key])
    hits = hits.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy("rank")) / F.col("rank"))
    per = hits.groupBy(by).agg(F.count("*").alias("_n"), F.min("rank").alias("_first"), F.sum("_p").alias("_sum"))
    total = relevant.groupBy(by).agg(F.count("*").alias("_all"))
    n = F.coalesce("_n", F.lit(0))
    return total.join(per, by, "left").select(by, (n > 0).cast("int").alias("hit"), F.round(n / F.col("_all"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("_sum") / F.col("_all"), F.lit(0.0)), 6).alias("average_precision"))


def ndcg(graded: DataFrame, by: str, grade: str, rank: str, depth: int = 5) -> DataFrame:
    """(by, ndcg, precision): gain 2**grade - 1 over log2(rank + 1); the ideal orders the grades that are shown."""
    gain = lambda place: (F.pow(2.0, F.col(grade)) - 1) / F.log2(place + 1)
    shown = graded.filter(F.col(rank) <= depth)
    ideal = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(grade), rank))
    shown = shown.withColumn("_ideal", ideal)
    per = shown.groupBy(by).agg(F.sum(gain(F.col(rank))).alias("_got"), F.sum(gain(F.col("_ideal"))).alias("_best"), F.avg((F.col(grade) > 0).cast("double")).alias("_p"))
    return per.select(by, F.round(F.when(F.col("_best") > 0, F.col("_got") / F.col("_best")).otherwise(0.0), 6).alias("ndcg"), F.round("_p", 6).alias("precision"))


def wilson(good: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    p, d = good / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / d
    return F.round(mid - half, 6), F.round(mid + half, 6)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two ratings; kappa is 1 where chance agreement is complete."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    left, right = (pairs.groupBy(F.col(c).alias("x")).agg(F.count("*").alias(f"n{c}")) for c in (a, b))
    pe = left.join(right, "x").agg(F.coalesce(F.sum(F.col(f"n{a}") * F.col(f"n{b}")), F.lit(0)).alias("s"))
    chance = F.col("s") / (F.col("n") * F.col("n"))
    return n.join(pe, how="cross").select("n", F.round("po", 6).alias("agreement"), F.round(F.when(chance == 1, 1.0).otherwise((F.col("po") - chance) / (1 - chance)), 6).alias("kappa"))


def bootstrap(values: DataFrame, key: str, value: str, rounds: int = 200) -> DataFrame:
    """(round, mean) of resamples: each round weighs a row by a Poisson(1) count drawn from a digest of row and round, so
    rows need no common order and any engine draws the same.

    A digest serves four rounds, each with eight of its digits; a task sums each round before anything is shuffled, so a
    shuffle has rounds times tasks sums.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("_four").cast("string")).cast("binary"))
    drawn = values.select(key, value, F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 4))).alias("_four")).withColumn("_d", digest)
    sums = []
    for j in range(4):
        u = F.conv(F.substring("_d", 8 * j + 1, 8), 16, 10).cast("double") / 4294967296.0
        weight = sum((F.when(u >= edge, 1).otherwise(0) for edge in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))
        sums += [F.sum(weight * F.col(value)).alias(f"s{j}"), F.sum(weight).alias(f"w{j}")]
    four = drawn.groupBy("_four").agg(*sums)
    each = four.select(F.explode(F.array(*[F.struct((F.col("_four") * 4 + j + 1).alias("round"), F.round(F.col(f"s{j}") / F.col(f"w{j}"), 6).alias("mean")) for j in range(4)])).alias("x"))
    return each.select("x.round", "x.mean").filter(F.col("round") <= rounds)


#: Distribution function of Poisson(1) at 0 to 6.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406, 0.999917)


def floor_percentile(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The element at place floor(p * n), from 0, of the sorted values; a value that is repeated is counted once with its number."""
    placed = ranks.before(df.groupBy(*by, value).agg(F.count("*").alias("_c")), by, [value], "_c")
    at = F.floor(F.lit(p) * F.col("total"))
    return placed.filter((F.col("before") <= at) & (at < F.col("before") + F.col("_c"))).select(*by, F.col(value).alias(f"p{round(p * 100)}"))


def interval(values: DataFrame, key: str, value: str, rounds: int = 2000) -> DataFrame:
    """(mean, low, high, not_above): the mean, the elements at 2.5 % and 97.5 % of the sorted resample means (from 0), and
    the share of them that is not above 0. Only as many rows as rounds meet in the last window."""
    means = bootstrap(values, key, value, rounds)
    placed = means.withColumn("_i", F.row_number().over(Window.orderBy("mean", "round")) - 1)
    at = lambda share: F.max(F.when(F.col("_i") == round(share * rounds), F.col("mean")))
    ends = placed.agg(at(0.025).alias("low"), at(0.975).alias("high"), F.avg((F.col("mean") <= 0).cast("double")).alias("not_above"))
    return values.agg(F.round(F.avg(value), 6).alias("mean")).join(ends, how="cross")


def with_abstention(run: DataFrame, judged: DataFrame, by: str, key: str, nothing, depth: int = 10) -> DataFrame:
    """(by, ap, rr) for each question of a run (by, key, rank). One without judged answers scores 1 if its only row is
    nothing, else 0."""
    relevant = judged.select(by, key).distinct()
    hits = run.filter(F.col("rank") <= depth).join(relevant, [by, key])
    hits = hits.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy("rank")) / F.col("rank"))
    per = hits.groupBy(by).agg(F.sum("_p").alias("_sum"), F.min("rank").alias("_first"))
    asked = run.groupBy(by).agg(((F.count("*") == 1) & F.bool_and((F.col(key) == nothing) & (F.col("rank") == 1))).alias("_abstains"))
    total = relevant.groupBy(by).agg(F.count("*").alias("_all"))
    joined = asked.join(per, by, "left").join(total, by, "left")
    score = lambda v: F.round(F.when(F.col("_all").isNull(), F.col("_abstains").cast("double")).otherwise(F.coalesce(v, F.lit(0.0))), 6)
    return joined.select(by, score(F.col("_sum") / F.col("_all")).alias("ap"), score(1.0 / F.col("_first")).alias("rr"))
