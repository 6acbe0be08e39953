"""What several of the operators need: shared storage, worker caches, connected components."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave that unset; then it
    is set to a new local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back. This cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over; it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def beside(df: DataFrame, **values: Column) -> DataFrame:
    """(row, and the values): a table's columns in one, so that no name of theirs clashes with what is put beside them."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), *(v.alias(k) for k, v in values.items()))


def dealt(work: DataFrame, most: int = 20_000) -> DataFrame:
    """Rows that each stand for a piece of work, dealt evenly to a stated number of tasks.

    Such rows are small, so adaptive execution would gather them in one task if the number were left to it. There are as
    many tasks as rows, but no more than most; a task then takes several.
    """
    n = max(1, min(most, work.count()))
    return work.repartition(n)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_passagework_cache", {})


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) longs, any order.

    Alternating large-star and small-star steps; each round is a table in the shared folder, and the loop ends when a
    round changes nothing. A hub's neighbours are never gathered: the minimum is a partial aggregate and the links come
    from a join, whose hot keys adaptive execution splits.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        kept = near.filter("b > a") if large else near
        joined = kept.join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = materialize(star(star(now, True), False), "edges")
        got = state(after)
        drop_table(now)
        now = after
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
