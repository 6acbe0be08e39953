"""Ranks and prefix sums within groups that may hold any share of the rows: by ranges of a group, never by a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def before(rows: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None, falling: bool = False) -> DataFrame:
    """rows with before and total: the sum of weights (or number of rows) that come before a row in its group, and of all.

    order must tell the rows of a group apart. Rows are sorted in range partitions by group and order; sums of the parts
    of groups that lie in a partition give each part its start, and a window covers one part. Nulls come as Spark sorts them.
    """
    sort = [F.col(c).desc() if falling else F.col(c).asc() for c in order]
    spread = rows.withColumn("_w", F.col(weight) if weight else F.lit(1).cast("long"))
    keys = [F.col(c) for c in by]
    placed = kept(spread.repartitionByRange(*keys, *sort).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("_part", *by).agg(F.sum("_w").alias("_in"))
    along, whole = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)
    own = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    starts = parts.select(F.col("_part").alias("_p"), *own, (F.sum("_in").over(along) - F.col("_in")).alias("_start"), F.sum("_in").over(whole).alias("total"))  # a row for each part
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = placed.join(starts, same).drop("_p", *(f"_by{i}" for i in range(len(by))))
    inside = F.sum("_w").over(Window.partitionBy("_part", *by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("before", F.col("_start") + inside - F.col("_w")).drop("_w", "_part", "_start")


def ranked(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n, rank, total): for each value of a group its number of rows, 1 + the number of rows of greater values,
    and the group's rows. Values are counted before they are ranked, so one that many rows share is one row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return before(counts, by, [value], "n", falling=True).select(*by, value, "n", (F.col("before") + 1).alias("rank"), "total")


def slots(rows: DataFrame, by: Sequence[str], order: Sequence[str], m: int) -> DataFrame:
    """rows with slot: an even split of each group's rows, in an order that tells them apart, into m slots, the remainder first."""
    placed = before(rows, by, order)
    small, more = F.floor(F.col("total") / m), F.col("total") % m
    wide = more * (small + 1)
    slot = F.when(F.col("before") < wide, F.floor(F.col("before") / (small + 1))).otherwise(more + F.floor((F.col("before") - wide) / F.greatest(small, F.lit(1))))
    return placed.withColumn("slot", (slot + 1).cast("int")).drop("before", "total")
