"""A written index for ranking: postings in blocks of neighbouring documents, each with its greatest weight.

A row of the index is one word's postings in one block of documents. A batch of queries is answered in three looks: the
blocks that their weightiest words value most give each query a score to reach; words whose greatest weights together stay
below that need not propose blocks; and only blocks whose sum of maxima reaches the score are read. So most postings are
never read, and no document that shares a mere common word is shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieve import B, K1
from .shared import kept, new_path

#: Documents of a block, the weightiest words of a query that are looked up first, and the blocks then read for it.
BLOCK, FIRST_WORDS, FIRST_BLOCKS = 32, 4, 8
#: What rounding a score may add to it.
SLACK = 1e-4


@dataclass(frozen=True)
class Index:
    """A table of postings (token, field, block, n, most, docs, weights), bucketed by token and block, and its words (token, of
    which field, idf, top). Weights want to be multiplied by idf."""

    name: str
    words: DataFrame
    key: str

    def table(self, spark) -> DataFrame:
        return spark.table(self.name)


def build(docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]], near: list[Column] | None = None, block: int = BLOCK, buckets: int = 32, **how) -> Index:
    """An index of the texts of one or more fields, each with the factor by which its BM25 counts.

    A field has its own document frequencies and mean length; a null text counts as an empty one. Documents of an input
    split that are alike in near share blocks. Keys must be unique. The table is written to the shared
    folder, bucketed by word and block, so that a common word is spread, and stays in the session's catalog until dropped.
    """
    spark, names = docs.sparkSession, list(fields)
    order = [f"n{i}" for i in range(len(near))] if near else ["doc"]
    placed = docs.select(F.col(key).alias("doc"), *(n.alias(f"n{i}") for i, n in enumerate(near or [])), *(c.alias(f"c{i}") for i, (c, _) in enumerate(fields.values())))
    placed = placed.sortWithinPartitions(*order, "doc").withColumn("block", F.floor(F.monotonically_increasing_id() / block))
    placed = kept(placed.select("doc", "block", *(tokens(F.col(f"c{i}"), **how).alias(f"t{i}") for i in range(len(names)))), "tokens")
    each = [placed.select("doc", "block", F.lit(i).alias("field"), F.col(f"t{i}").alias("ts"), F.size(f"t{i}").alias("len")) for i in range(len(names))]
    rows = each[0]
    for e in each[1:]:
        rows = rows.union(e)
    means = {r.field: (r.n, r.mean) for r in rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).collect()}  # a row for each field
    number = lambda pick, default: F.coalesce(F.element_at(F.create_map(*[x for f in means for x in (F.lit(f), F.lit(float(pick(f))))]) if means else F.create_map(F.lit(0), F.lit(default)), F.col("field")), F.lit(default))
    n_docs, mean, factor = number(lambda f: means[f][0], 0.0), number(lambda f: max(means[f][1] or 0.0, 1.0), 1.0), number(lambda f: fields[names[f]][1], 1.0)
    found = rows.select("doc", "block", "field", "len", F.explode("ts").alias("token")).repartition(buckets, "token", "block")
    runs = found.groupBy("token", "field", "block").agg(F.collect_list(F.struct("doc", "len")).alias("all"))  # one word in the documents of a block
    runs = runs.withColumn("p", F.array_distinct("all"))
    tf = F.transform("p", lambda x: F.size(F.filter("all", lambda y: y["doc"] == x["doc"])))
    weights = F.zip_with("p", tf, lambda x, f: f * (K1 + 1) / (f + K1 * (1 - B + B * x["len"] / mean)))
    out = runs.select("token", "field", "block", F.size("p").alias("n"), F.col("p.doc").alias("docs"), weights.alias("weights")).withColumn("most", F.array_max("weights"))
    name = f"postings_{uuid.uuid4().hex}"
    out.write.format("parquet").bucketBy(buckets, "token", "block").sortBy("token", "block").option("path", new_path(spark, "postings")).saveAsTable(name)
    df = spark.table(name).groupBy("token", "field").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) * factor
    return Index(name, kept(df.select("token", F.col("field").alias("of"), idf.alias("idf"), (F.col("most") * idf).alias("top")), "words"), key)


def _asked(queries: DataFrame, by: str, text: Column, words: DataFrame, **how) -> DataFrame:
    """(by, token, asked, top, rest): each query's distinct words, with the greatest weight of each and the sum of those of
    the words that weigh no more, itself included. Words that no document has stay, without weight."""
    asked = queries.select(by, F.array_distinct(tokens(text, **how)).alias("_t")).select(by, F.size("_t").alias("asked"), F.explode("_t").alias("token"))
    fields = words.groupBy("token").agg(F.sum("top").alias("top"), F.collect_list(F.struct("of", "idf")).alias("fields"))
    own = asked.join(fields, "token", "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    light = Window.partitionBy(by).orderBy("top", "token")  # a query's words
    return kept(own.withColumn("rest", F.sum("top").over(light)).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("top"), F.desc("token")))), "asked")


def _of_fields(asked: DataFrame) -> DataFrame:
    """asked with a row for each field that has the word: of and idf."""
    return asked.withColumn("_f", F.explode("fields")).withColumn("of", F.col("_f.of")).withColumn("idf", F.col("_f.idf")).drop("_f", "fields")


def _summed(asked: DataFrame, postings: DataFrame, pairs: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, score, hits, asked, coverage) of all documents of the pairs (by, block): only these blocks' postings are read."""
    wanted = pairs.join(_of_fields(asked).select(by, "token", "of", "idf", "asked"), by)
    read = postings.select("token", "block", "field", F.arrays_zip("docs", "weights").alias("p")).join(wanted, ["token", "block"]).filter("field = of")
    hits = read.select(by, "asked", "token", "idf", F.explode("p").alias("x")).select(by, "asked", "token", F.col("x.docs").alias(key), (F.col("x.weights") * F.col("idf")).alias("w"))
    found = hits.groupBy(by, key).agg(F.round(F.sum("w"), 4).alias("score"), F.count_distinct("token").alias("hits"), F.first("asked").alias("asked"))
    return found.withColumn("coverage", F.round(F.col("hits") / F.col("asked"), 4))


def _first_pairs(asked: DataFrame, postings: DataFrame, by: str, words: int = FIRST_WORDS, blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(by, block): the blocks that each query's weightiest words value most."""
    some = _of_fields(asked.filter(F.col("place") <= words)).select(by, "token", "of", "idf").join(postings.select("token", "field", "block", "most"), "token").filter("field = of")
    bound = some.groupBy(by, "block").agg(F.sum(F.col("most") * F.col("idf")).alias("bound"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("bound"), "block"))
    return bound.withColumn("_r", rank).filter(F.col("_r") <= blocks).select(by, "block")


def open_pairs(asked: DataFrame, postings: DataFrame, floor: DataFrame, by: str) -> DataFrame:
    """(by, block, bound): the blocks that may hold a document whose score reaches the query's floor (by, floor).

    Words whose greatest weights, taken from the lightest up, sum to less than the floor cannot lift a document to it alone:
    they propose no blocks, and count with their greatest weights.
    """
    own = asked.join(floor, by, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    light = own.groupBy(by).agg(F.max(F.when(F.col("rest") < F.col("floor"), F.col("rest"))).alias("light"))
    heavy = own.filter(F.col("rest") >= F.col("floor")).join(light, by)
    met = _of_fields(heavy).select(by, "token", "of", "idf", "floor", "light").join(postings.select("token", "field", "block", "most"), "token").filter("field = of")
    bound = met.groupBy(by, "block").agg((F.sum(F.col("most") * F.col("idf")) + F.coalesce(F.first("light"), F.lit(0.0))).alias("bound"), F.first("floor").alias("floor"))
    return bound.filter(F.col("bound") >= F.col("floor")).select(by, "block", "bound")


def top_k(index: Index, queries: DataFrame, by: str, text: Column, k: int, order: list[Column] | None = None, seen: list | None = None, **how) -> DataFrame:
    """(by, key, score, hits, asked, coverage, rank): each query's k best documents by BM25, ties to the smaller key; as if
    all were scored. A list given as seen gets the DataFrame of the pairs (by, block) that are read."""
    postings, key = index.table(queries.sparkSession), index.key
    asked = _asked(queries, by, text, index.words, **how)
    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)
    first = ranked(_summed(asked, postings, _first_pairs(asked, postings, by), by, key))
    floor = kept(first.groupBy(by).agg(F.when(F.count("*") == k, F.min("score")).alias("floor")), "floor")
    pairs = kept(open_pairs(asked, postings, floor, by), "pairs")
    if seen is not None:
        seen += [asked, pairs]
    return ranked(_summed(asked, postings, pairs, by, key))


def above(index: Index, queries: DataFrame, by: str, text: Column, share: float, least: float, **how) -> DataFrame:
    """(by, key, score, hits, asked, coverage) of all documents that hold every word of a query, or reach the share of its
    best score and hold the least share of its words: what a relevance cut-off looks at."""
    postings, key = index.table(queries.sparkSession), index.key
    asked = _asked(queries, by, text, index.words, **how)
    best = kept(_summed(asked, postings, _first_pairs(asked, postings, by), by, key).groupBy(by).agg((F.max("score") * share).alias("floor")), "floor")
    have = asked.select(by, "token", "asked").join(postings.select("token", "block").distinct(), "token").groupBy(by, "block").agg(F.count("*").alias("may"), F.first("asked").alias("asked"))
    full = have.filter("may = asked").select(by, "block")
    some = open_pairs(asked, postings, best, by).join(have.filter(F.col("may") >= F.col("asked") * least), [by, "block"]).select(by, "block")
    return _summed(asked, postings, kept(full.union(some).distinct(), "pairs"), by, key)


def postings_read(index: Index, asked: DataFrame, pairs: DataFrame, by: str) -> tuple[int, int]:
    """(read, all): postings of the blocks that a search read, and those of all words that it asked for in any block."""
    own = index.table(asked.sparkSession).select("token", "block", "n")
    read = pairs.join(asked.select(by, "token"), by).join(own, ["token", "block"]).agg(F.sum("n")).first()[0]
    return read or 0, asked.select(by, "token").join(own, "token").agg(F.sum("n")).first()[0] or 0
