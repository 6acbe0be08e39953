"""Event logs: streaks, rolling sums, runs, schedules; all by windows over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(events: DataFrame, user: str = "user_id", at: str = "ts", value: str = "value") -> DataFrame:
    """(user, day, n, total): one row a user and active day."""
    return events.groupBy(user, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def islands(days: DataFrame, by: list[str], day: Column) -> DataFrame:
    """(by, first_day, last_day, length) of runs of consecutive days: gaps and islands."""
    runs = days.select(*by, day.alias("_day")).distinct().withColumn("_island", F.date_sub("_day", F.row_number().over(Window.partitionBy(*by).orderBy("_day"))))
    return runs.groupBy(*by, "_island").agg(F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.count("*").alias("length")).drop("_island")


def streak(days: DataFrame, by: list[str], as_of: Column) -> DataFrame:
    """(by, streak): length of the run that ends on the day or the day before, else 0."""
    runs = islands(days.filter(F.col("day") <= as_of), by, F.col("day"))
    return runs.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("last_day") >= F.date_sub(as_of, 1), F.col("length"))), F.lit(0)).alias("streak"))


def rolling(days: DataFrame, by: list[str], value: str, width: int) -> Column:
    """Sum over the last so many days, the row's own included; days without rows count as none."""
    number = F.datediff(F.col("day"), F.lit("1970-01-01"))
    return F.sum(value).over(Window.partitionBy(*by).orderBy(number).rangeBetween(-(width - 1), 0))


def sessions(events: DataFrame, by: list[str], at: str, key: str, gap_seconds: int) -> DataFrame:
    """(by, session, begins, ends, first_event, n): events no more than a gap apart; equal times are ordered by key."""
    w = Window.partitionBy(*by).orderBy(at, key)
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce((moment - F.lag(moment).over(w) > gap_seconds * 1_000_000).cast("long"), F.lit(0))
    marked = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return marked.groupBy(*by, "session").agg(F.min(at).alias("begins"), F.max(at).alias("ends"), F.min(key).alias("first_event"), F.count("*").alias("n"))


def portions(units: DataFrame, by: list[str], order: list[str], weight: str, goal: float) -> Column:
    """Number of the portion a unit falls in: it goes where most of it lies, by the running sum of weights."""
    upto = F.sum(weight).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return F.floor(F.greatest(F.lit(0.0), upto - F.col(weight) / 2) / goal).cast("long")


def last_days(days: DataFrame, by: list[str], most: int = 120) -> DataFrame:
    """The last so many days of each user."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("day")))
    return days.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def interpolated(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Missing values on the line between the known ones around them; before the first and after the last, the nearest."""
    w = Window.partitionBy(*by).orderBy(at)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    x = rows.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col(at) - a["at"]) / (b["at"] - a["at"])
    return x.withColumn(value, F.coalesce(F.col(value), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line))).drop("_a", "_b")


def breaker(events: DataFrame, by: list[str], at: str, tie: str, failed: Column, failures: int, seconds: int) -> DataFrame:
    """(by, opens, refused): a run of so many failures opens a breaker; calls within the time after are refused."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    e = events.withColumn("_failed", failed).withColumn("_i", F.row_number().over(w))
    e = e.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*by, "_failed").orderBy("_i")))
    e = e.withColumn("_streak", F.when(F.col("_failed"), F.row_number().over(Window.partitionBy(*by, "_failed", "_run").orderBy("_i"))).otherwise(0))
    opens = F.col("_streak") == failures
    opened = F.max(F.when(opens, F.unix_micros(F.col(at).cast("timestamp")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_opened", opened)
    return e.groupBy(*by).agg(F.count_if(opens).alias("opens"), F.count_if(F.col("_opened").isNotNull() & (F.unix_micros(F.col(at).cast("timestamp")) < F.col("_opened") + seconds * 1_000_000)).alias("refused"))


def window_limit(events: DataFrame, by: list[str], at: str, tie: str, seconds: int, most: int) -> DataFrame:
    """(by, n, rejected): calls beyond a limit in windows that start with a call and restart after so many seconds.

    A window's start depends on the one before, so each key's calls are folded in order; the state is two numbers. Calls
    of one key come sorted from Spark in batches, they are never gathered.
    """
    import pyarrow as pa

    kinds = events.select(*by).schema

    def fold(batches):
        key, began, n, total, rejected, out = None, 0, 0, 0, 0, []
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            for k, s in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((*key, total, rejected))
                    key, began, n, total, rejected = k, s, 0, 0, 0
                if s - began >= seconds:
                    began, n = s, 0
                n, total = n + 1, total + 1
                rejected += n > most
            yield from rows(out)
            out = []
        if key is not None:
            yield from rows([(*key, total, rejected)])

    def rows(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*by, "n", "rejected"])

    ordered = events.repartition(*by).sortWithinPartitions(*by, at, tie).select(*by, F.unix_seconds(F.col(at).cast("timestamp")).alias("_s"))
    return ordered.mapInArrow(fold, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", n long, rejected long")
