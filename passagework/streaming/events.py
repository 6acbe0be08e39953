"""Structured Streaming over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.shared import new_path


def as_stream(table: DataFrame) -> DataFrame:
    """All files of a Parquet table as a stream.

    A table of one file may lie beside others, so its folder is read with a filter; one of several has a folder of its
    own, with folders for partitions in it or not.
    """
    files = table.inputFiles()
    folders = [f.rpartition("/")[0].split("/") for f in files]
    shared = next((i for i, parts in enumerate(zip(*folders)) if len(set(parts)) > 1), min(map(len, folders)))
    root, inner = "/".join(folders[0][:shared]), {p for f in folders for p in f[shared:]}
    reader = table.sparkSession.readStream.schema(table.schema)
    if len(files) == 1:
        reader = reader.option("pathGlobFilter", files[0].rpartition("/")[2])
    elif any("=" not in p for p in inner):
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(root).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def daily_counts(table: DataFrame) -> DataFrame:
    """(day, event_type, n): the stream runs until its input is read; each batch writes the complete table anew to the
    shared folder, and the last one is the result."""
    spark = table.sparkSession
    path, state = new_path(spark, "daily"), new_path(spark, "daily-state")
    counts = windowed(as_stream(table)).select(F.to_date("window.start").alias("day"), "event_type", "n")
    spark.createDataFrame([], counts.schema).write.parquet(path)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


def rate_limited(stream: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """(user_id, event_id, allowed): a window opens at a user's first event and opens anew with the first one after its
    end; events beyond the most in it are rejected."""

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, n = state.get if state.exists else (None, 0)
        for pdf in frames:
            out = []
            for row in pdf.sort_values(["ts", "event_id"]).itertuples():
                at = row.ts.timestamp()
                if begun is None or at - begun >= seconds:
                    begun, n = at, 0
                n += 1
                out.append((key[0], row.event_id, n <= most))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])
        state.update((begun, n))

    return stream.groupBy("user_id").applyInPandasWithState(one, "user_id long, event_id long, allowed boolean", "begun double, n long", "append", GroupStateTimeout.NoTimeout)
