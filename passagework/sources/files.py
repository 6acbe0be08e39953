"""Readers and writers: delimited and tabular text, JSON, XML, binary matrices; sharded output with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, names: list[str], sep: str = "|", comment: str = "#") -> DataFrame:
    """Lines of parts; the last part holds what is left of its line, comment and blank lines are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split("value", f"[{sep}]", len(names))
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows of a schema; rows that do not fit are dropped (S6, TREC runs)."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="DROPMALFORMED")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header, quotes and line ends in quotes."""
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True, sep=sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank and broken ones skipped; gzip by its name."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row for each element of a tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def matrix_rows(content: DataFrame, dim: int, dtype: str = "int8") -> DataFrame:
    """(path, row, v): rows of raw little-endian matrices in the columns (path, content)."""
    import numpy as np
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = np.frombuffer(raw.as_buffer(), dtype).reshape(-1, dim)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096].astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), lists], names=["path", "row", "v"])

    return content.select("path", "content").mapInArrow(rows, "path string, row long, v array<float>")


def read_matrix(spark: SparkSession, path: str, dim: int, dtype: str = "int8") -> DataFrame:
    """matrix_rows() of the files under a path, one file a row."""
    return matrix_rows(spark.read.format("binaryFile").load(path), dim, dtype)


def read_wide(spark: SparkSession, path: str, least: int, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """Named columns (place, type) of tab-separated lines with at least so many fields; others are dropped."""
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path).filter(F.size(parts) >= least)
    return lines.select(*[F.get(parts, F.lit(i)).try_cast(kind).alias(name) for name, (i, kind) in columns.items()])


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON value, an array of rows or a row, over many lines."""
    return spark.read.json(path, schema=schema, multiLine=True)


def counted(df: DataFrame, n: int) -> DataFrame:
    """df, whose job fails if it has not n rows."""
    found = df.agg(F.assert_true(F.count("*") == n, F.lit(f"{n} rows were expected")).alias("ok"))
    return df.join(F.broadcast(found), F.col("ok").isNull()).drop("ok")


def markdown(rows: DataFrame) -> DataFrame:
    """(line): the rows as lines of a Markdown table, with its two lines of heading (S26). Reports are small aggregates."""
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in rows.columns]), F.lit(" |")).alias("line"))
    heads = [(f"| {' | '.join(rows.columns)} |",), (f"|{'-|' * len(rows.columns)}",)]
    return rows.sparkSession.createDataFrame(heads, "line string").union(body)


class Sources:
    """Named sources of like columns, attached and detached; nothing is read before it is asked for."""

    def __init__(self):
        self.held: dict[str, DataFrame] = {}

    def attach(self, name: str, df: DataFrame) -> None:
        self.held[name] = df

    def detach(self, name: str) -> None:
        self.held.pop(name, None)

    def rows(self) -> DataFrame:
        """All rows of the attached sources."""
        first, *rest = self.held.values()
        for df in rest:
            first = first.unionByName(df)
        return first


def write_shards(df: DataFrame, path: str, by: list[str], rows_per_file: int = 100_000, spread: int = 64) -> None:
    """Parquet in one folder for each value of by, files of bounded length (S21). A value goes to spread tasks at most."""
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(spread))).write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256, modified) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys a Parquet table does not have yet; returns their number."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(conf).exists(place):
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def kept_votes(votes: DataFrame, now, days: int = 365) -> DataFrame:
    """Votes of the retention time."""
    return votes.filter(F.col("at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
