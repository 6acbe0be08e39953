"""Guards of a service as streams: calls are folded in order of time for each user, however late or often they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shared import new_path

CALL = "ts timestamp, event_id long, failed boolean"
OUT = "user_id long, event_id long, value long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limit(most: int, seconds: int) -> Callable:
    """A fold of calls: 1 for a call beyond the most in a window that opens with a call and anew with the first after its end."""

    def step(held: tuple[int, int], at: int, failed: bool) -> tuple[tuple[int, int], int]:
        (begun, n), second = held, at // 1_000_000
        begun, n = (second, 1) if n == 0 or second - begun >= seconds else (begun, n + 1)
        return (begun, n), int(n > most)

    return step


def breaker(failures: int, seconds: int) -> Callable:
    """A fold of calls: 1 for a call that is refused as the breaker is open, 2 added for a failure that opens it."""

    def step(held: tuple[int, int], at: int, failed: bool) -> tuple[tuple[int, int], int]:
        until, run = held
        run = run + 1 if failed else 0
        opens = run == failures
        return (at + seconds * 1_000_000 if opens else until, run), int(at < until) + 2 * opens

    return step


class Ordered(StatefulProcessor):
    """Holds a user's calls until the watermark has passed them, then folds them in order of time and event_id.

    A call that arrives again while its first copy is held counts once; one that comes after the watermark has passed it is
    dropped by Spark. State: two numbers, and the calls of the last stretch.
    """

    def __init__(self, step: Callable):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "a long, b long")
        self.waiting = handle.getListState("waiting", CALL)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(r.ts.to_pydatetime(), int(r.event_id), bool(r.failed)) for frame in rows for r in frame.itertuples()]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(int(pd.Timestamp(ts).timestamp() * 1000) for ts, _, _ in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        calls = sorted({e: (pd.Timestamp(ts).value // 1000, e, failed) for ts, e, failed in self.waiting.get()}.values())
        held, out = (tuple(self.held.get()) if self.held.exists() else (0, 0)), []
        for at, event, failed in calls:
            if at // 1000 < now:
                held, value = self.step(held, at, failed)
                out.append((key[0], event, value))
        self.held.update(held)
        left = [(pd.Timestamp(at * 1000).to_pydatetime(), e, failed) for at, e, failed in calls if at // 1000 >= now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value"])

    def close(self) -> None:
        pass


def folded(calls: DataFrame, step: Callable, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, value) of a stream (user_id, ts, event_id, failed), as the watermark passes the calls."""
    return calls.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Ordered(step), OUT, "Append", "EventTime")


def replayed(events: DataFrame, failed: Column, step: Callable, late_share: int = 7, again_share: int = 5) -> DataFrame:
    """What the guard says of a table of events (user_id, ts, event_id) that arrives as a stream: in two halves by time, of
    whose calls one in late_share comes with the other half (but no later than the watermark allows) and one in again_share
    twice; a last row beyond all others lets the watermark pass them. Users without an id take no part.

    The halves and the last row are files in the shared folder that come one after the other; each batch's rows are written under its number, so a batch that runs again
    writes the same.
    """
    spark, day = events.sparkSession, 86_400
    rows = events.filter("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), failed.alias("failed"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return spark.createDataFrame([], OUT)
    source, target = new_path(spark, "calls"), new_path(spark, "folded")
    middle = first + (last - first) / 2
    half, late = F.col("ts") >= F.lit(middle), F.pmod(F.xxhash64("event_id"), F.lit(late_share)) == 0
    again = F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(again_share)) == 0
    span = int((last - first).total_seconds()) + day
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("user_id"), (F.lit(last) + F.make_dt_interval(secs=F.lit(2 * span))).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(False).alias("failed"))
    spark.createDataFrame([], OUT).write.parquet(target + "/none")
    setting, state = "spark.sql.streaming.stateStore.providerClass", new_path(spark, "folded-state")
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        for k, part in enumerate((rows.filter(~half & ~late), rows.filter(half | late).union(rows.filter(again)), end)):
            part.write.parquet(f"{source}/{k}")  # arrives when what was there before has been read; the stream goes on from its checkpoint
            stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(source)
            write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/{n}")
            folded(stream, step, f"{span} seconds").writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(target)
