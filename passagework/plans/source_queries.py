"""Queries through sources and sinks: rows are written in a format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules
from ..operators.shared import new_path
from ..sources import files
from .registry import query


def _lines(df, line, label):
    """Text files of one column, in the shared folder."""
    path = new_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


@query("delimited_source", "SELECT CAST(c_custkey AS VARCHAR) AS a, CAST(c_nationkey AS VARCHAR) AS b, c_name || '|' || c_mktsegment AS c FROM customer")
def delimited_source(t):
    """Lines of three parts, the last holds what is left; comments and blank lines are skipped, rows are counted."""
    c = t("customer")
    rows = F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_name", "c_mktsegment")
    path = _lines(c.select(F.explode(F.array(F.lit("# a comment"), F.lit(""), rows)).alias("v")), F.col("v"), "delimited")
    return files.counted(files.read_delimited(c.sparkSession, path, ["a", "b", "c"]), c.count())


@query("table_source", "SELECT CAST(p_partkey AS INT) AS c0, p_name AS c1, p_retailprice AS c18 FROM part WHERE p_partkey % 3 <> 0")
def table_source(t):
    """Tab-separated rows of nineteen columns, cast; rows of fewer are dropped."""
    p = t("part")
    fill = [F.lit("x")] * 16
    whole = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", *fill, F.col("p_retailprice").cast("string"), F.lit("over"))
    path = _lines(p, F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("short"))).otherwise(whole), "table")
    return files.read_wide(p.sparkSession, path, 19, {"c0": (0, "int"), "c1": (1, "string"), "c18": (18, "double")})


@query("csv_source", "SELECT CAST(s_suppkey AS INT) AS id, 'said \"' || s_name || '\"; then, left' AS note FROM supplier")
def csv_source(t):
    """Comma and semicolon separated files with a byte order mark, quotes, and separators in quotes."""
    s, out = t("supplier"), None
    for sep in (",", ";"):
        part = s.filter(F.col("s_suppkey") % 2 == (0 if sep == "," else 1)).select(F.col("s_suppkey").cast("int").alias("id"), F.concat(F.lit('said "'), "s_name", F.lit('"; then, left')).alias("note"))
        path = new_path(s.sparkSession, "csv")
        mark = "﻿"
        part.withColumnRenamed("id", f"{mark}id").write.csv(path, header=True, sep=sep, quote='"', escape='"')
        one = files.read_csv(s.sparkSession, path, sep=sep).select(F.col("id").cast("int"), "note")
        out = one if out is None else out.union(one)
    return out


@query("json_source", "SELECT conv_id, turn, role, text, 'plain' AS kind FROM conversations UNION ALL SELECT conv_id, turn, role, text, 'gzip' FROM conversations UNION ALL SELECT conv_id, turn, role, text, 'file' FROM conversations")
def json_source(t):
    """JSON lines with blank ones, the same compressed, and files that hold one indented array each."""
    c = t("conversations").select("conv_id", "turn", "role", "text")
    spark, schema, out = c.sparkSession, "conv_id long, turn long, role string, text string", None
    one = F.to_json(F.struct(*c.columns))
    for kind in ("plain", "gzip", "file"):
        path = new_path(spark, "json")
        if kind == "file":
            groups = c.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct(*c.columns)), {"pretty": "true"}).alias("value"))
            groups.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
        else:
            c.select(F.explode(F.array(one, F.lit(" "))).alias("value")).write.text(path, compression="gzip" if kind == "gzip" else "none")
        got = files.read_json_files(spark, path, schema) if kind == "file" else files.read_json_lines(spark, path, schema)
        got = got.filter("conv_id is not null").withColumn("kind", F.lit(kind))
        out = got if out is None else out.union(got)
    return out


@query("xml_source", "SELECT CAST(n_nationkey AS INT) AS id, n_name AS name, CAST(n_regionkey AS INT) AS region FROM nation")
def xml_source(t):
    """Elements of a tag, with attributes and children."""
    n = t("nation").select(F.col("n_nationkey").cast("int").alias("_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"))
    path = new_path(n.sparkSession, "xml")
    n.write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    return files.read_xml(n.sparkSession, path, "nation", "_id int, name string, region int").withColumnRenamed("_id", "id")


@query("matrix_source", "SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, CAST(greatest(-128, least(127, CAST(floor(embedding[i] * 64.0::DOUBLE) AS INT))) AS FLOAT) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def matrix_source(t):
    """Rows of raw one-byte numbers, parsed from binary content."""
    byte = lambda x: F.lpad(F.hex(F.pmod(F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * 64.0))).cast("int"), F.lit(256)).cast("long")), 2, "0")
    raw = t("embeddings").select(F.col("vec_id").cast("string").alias("path"), F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("content"))
    rows = files.matrix_rows(raw, 64, "int8")
    return rows.select(F.col("path").cast("long").alias("vec_id"), F.posexplode("v").alias("dim", "x")).select("vec_id", F.col("dim").cast("long"), "x")


@query("matrix_round_trip", "SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, CAST(greatest(-128, least(127, CAST(floor(embedding[i] * 64.0::DOUBLE) AS INT))) AS FLOAT) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def matrix_round_trip(t):
    """Vectors written as packed one-byte records with a commit, and read back by ranges of 16 KB."""
    from ..operators.shared import new_path
    from ..sources import matrices

    spark = t("embeddings").sparkSession
    matrices.register(spark)
    where = {"path": new_path(spark, "packed"), "dim": "64", "dtype": "int8", "range_bytes": str(1 << 14)}
    byte = F.transform("embedding", lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * 64.0))).cast("float"))
    t("embeddings").select(F.col("vec_id").alias("id"), byte.alias("v")).write.format("raw_matrix").options(**where).mode("append").save()
    rows = spark.read.format("raw_matrix").options(**where).load()
    return rows.select(F.col("id").alias("vec_id"), F.posexplode("v").alias("dim", "x")).select("vec_id", F.col("dim").cast("long"), "x")


@query("ordered_scan", "SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation WHERE n_regionkey <> 1")
def ordered_scan(t):
    """A table's columns under a filter, in a stated order within each group."""
    return t("nation").filter("n_regionkey <> 1").select("n_regionkey", "n_nationkey", "n_name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).cast("long").alias("place"))


@query("attached_sources", "SELECT field, count(*) AS n FROM (SELECT 'part' AS field FROM part UNION ALL SELECT 'supplier' FROM supplier) GROUP BY field")
def attached_sources(t):
    """Sources are attached by name and detached again; only attached ones take part."""
    held = files.Sources()
    for name in ("part", "supplier", "customer"):
        held.attach(name, t(name).select(F.lit(name).alias("field")))
    held.detach("customer")
    return held.rows().groupBy("field").agg(F.count("*").alias("n"))


@query("record_fetch", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def record_fetch(t):
    """Records by their numbers: number to shard and slot, an equal join, and the number checked again."""
    shard = lambda c: (F.floor(F.col(c) / 100).alias("shard"), (F.col(c) % 100).alias("slot"))
    asked = t("lineitem").filter("l_quantity = 50").select("l_orderkey", *shard("l_orderkey")).distinct()
    stored = t("orders").select("o_orderkey", "o_totalprice", *shard("o_orderkey"))
    return stored.join(asked, ["shard", "slot"]).filter("o_orderkey = l_orderkey").select("o_orderkey", "o_totalprice")


@query("json_sink", "SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS sha256, octet_length(encode('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}')) AS n_bytes FROM nation")
def json_sink(t):
    """Compact JSON, written, read back as bytes, with digest and size."""
    n = t("nation")
    path = _lines(n, F.to_json(F.struct("n_nationkey", "n_name")), "json")
    back = n.sparkSession.read.text(path)
    return back.select(F.get_json_object("value", "$.n_nationkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), F.sha2("value", 256).alias("sha256"), F.octet_length("value").cast("long").alias("n_bytes"))


@query("sharded_sink", "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS bounded FROM orders GROUP BY 1")
def sharded_sink(t):
    """A folder for each group, files of bounded length; read back whole."""
    o = t("orders").select("o_orderkey", "o_orderpriority")
    path = new_path(o.sparkSession, "shards")
    files.write_shards(o, path, ["o_orderpriority"], 100)
    back = o.sparkSession.read.parquet(path).withColumn("file", F.input_file_name())
    per = back.groupBy("o_orderpriority", "file").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return per.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), (F.max("n") <= 100).alias("bounded"))


@query("vote_retention", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 20 DAYS GROUP BY 1")
def vote_retention(t):
    """Votes within the retention time."""
    return files.kept_votes(t("events").withColumnRenamed("ts", "at"), "2024-01-30 00:00:00", 20).groupBy("event_type").agg(F.count("*").alias("n"))


@query("report_lines", "SELECT '| ' || event_type || ' | ' || count(*) || ' | ' || CAST(round(avg(value), 2) AS DECIMAL(12, 2)) || ' |' AS line FROM events GROUP BY event_type UNION ALL SELECT '| event_type | n | mean |' UNION ALL SELECT '|-|-|-|'")
def report_lines(t):
    """An aggregate as the lines of a Markdown table."""
    rows = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).cast("decimal(12,2)").alias("mean"))
    return files.markdown(rows)


@query("crawled_links", "WITH l AS (SELECT page_id, unnest(x) AS href, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS x FROM pages)) SELECT href, page_id, pos FROM (SELECT href, page_id, i AS pos, row_number() OVER (PARTITION BY href ORDER BY page_id, i) AS n FROM l) WHERE n = 1")
def crawled_links(t):
    """Links of pages, each address where it is seen first."""
    d = t("pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("p", "href"))
    first = rules.first_seen(d, ["href"], [F.col("page_id"), F.col("p")])
    return first.select("href", "page_id", (F.col("p") + 1).cast("long").alias("pos"))


@query("tree_levels", "WITH RECURSIVE nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent FROM part WHERE p_partkey > 0), w AS (SELECT id, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, depth + 1 FROM w JOIN nodes n ON n.parent = w.id WHERE depth < 4) SELECT CAST(depth AS INT) AS depth, count(*) AS n, min(id) AS first FROM w GROUP BY depth")
def tree_levels(t):
    """A tree walked breadth first to a depth of four."""
    from ..operators import tree

    p = F.col("p_partkey")
    nodes = t("part").filter(p > 0).select(p.alias("id"), F.when(p > 2, F.floor(p / 3)).alias("parent"))
    roots = nodes.filter("parent is null").select(F.lit(0).alias("walk"), "id", F.lit(0).alias("place"))
    depth = tree.walked(nodes, roots, "walk", 4).select("id", (F.size("path") - 1).alias("depth"))
    return depth.groupBy("depth").agg(F.count("*").alias("n"), F.min("id").alias("first"))
