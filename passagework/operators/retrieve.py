"""Inverted index, BM25, coverage, pruning and ranking, for whole batches of queries at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import scan
from .shared import kept

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: Column, **how) -> DataFrame:
    """(key, token, tf, len): term frequencies, and the document's length with duplicates."""
    listed = docs.select(F.col(key), tokens(text, **how).alias("_t")).withColumn("len", F.size("_t"))
    return listed.select(key, "len", F.explode("_t").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def weights(index: DataFrame) -> DataFrame:
    """An index (key, token, tf, len) with each posting's BM25 weight: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / average)).

    The index is read for each of three aggregates, so it should be a written table.
    """
    key = index.columns[0]
    return _weighed(index, index.groupBy(key).agg(F.first("len").alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")))


def _weighed(index: DataFrame, stats: DataFrame) -> DataFrame:
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    return index.join(df, "token").join(F.broadcast(stats), how="cross").withColumn("weight", idf * tf)  # stats: one row


def search(queries: DataFrame, query_key: str, query_text: Column, weighted: DataFrame, key: str, **how) -> DataFrame:
    """(query_key, key, score, hits, asked, coverage): scores summed over each query's distinct tokens, and how many of them hit."""
    return _summed(_asked(queries, query_key, query_text, **how).join(weighted, "token"), query_key, key)


def _asked(queries: DataFrame, query_key: str, query_text: Column, **how) -> DataFrame:
    asked = queries.select(query_key, F.array_distinct(tokens(query_text, **how)).alias("_t"))
    return asked.select(query_key, F.size("_t").alias("asked"), F.explode("_t").alias("token"))


def _summed(hits: DataFrame, query_key: str, key: str) -> DataFrame:
    found = hits.groupBy(query_key, key).agg(F.sum("weight").alias("score"), F.count("*").alias("hits"), F.first("asked").alias("asked"))
    return found.withColumn("score", F.round("score", 4)).withColumn("coverage", F.round(F.col("hits") / F.col("asked"), 4))


def tokenised(docs: DataFrame, key: str, text: Column, **how) -> DataFrame:
    """(key, len, ts): each document's tokens, written once and read back by what follows."""
    return kept(docs.select(F.col(key), tokens(text, **how).alias("ts")).withColumn("len", F.size("ts")), "tokens")


def search_all(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, key: str, text: Column, **how) -> DataFrame:
    """search() of a batch of queries in documents without an index: each text is tokenised once, and only the queries'
    tokens are counted, weighed and shuffled."""
    listed, asked = tokenised(docs, key, text, **how), kept(_asked(queries, query_key, query_text, **how), "asked")
    wanted = asked.select("token").distinct()
    tf = listed.select(key, "len", F.explode("ts").alias("token")).join(wanted, "token", "left_semi").groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return _summed(asked.join(_weighed(kept(tf, "postings"), listed.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))), "token"), query_key, key)


def _weighed_texts(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, key: str, text: Column, **how) -> tuple[DataFrame, DataFrame, scan.Weighed]:
    """Queries (query_key, ts) and texts (key, len, ts), both written, and what BM25 needs of all texts."""
    texts = tokenised(docs, key, text, **how)
    asked = kept(queries.select(query_key, F.array_distinct(tokens(query_text, **how)).alias("ts")), "asked")
    stats = texts.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    wanted = asked.select(F.explode("ts").alias("token")).distinct()
    df = texts.select(F.explode(F.array_distinct("ts")).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    idf = {r["token"]: math.log(1 + (stats["n"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in df.collect()}
    return asked, texts, scan.Weighed(idf, stats["mean"] or 0.0, K1, B)


def listed(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, key: str, text: Column, orders: list[list[tuple[str, bool]]], k: int, **how) -> DataFrame:
    """(list_no, query_key, key, score, coverage, hits): rows of search_all() that hold for each order, of these columns and
    "key", each query's k first, and few others. Texts are scored where they lie, so hits are not shuffled; the words that
    are asked are weighed on the driver, which has the queries in blocks."""
    asked, texts, w = _weighed_texts(queries, query_key, query_text, docs, key, text, **how)
    found = scan.ranked_lists(asked, texts, w, query_key, key, orders, k)
    if found is not None:
        return found
    return asked.crossJoin(texts).filter("false").select(F.lit(0).cast("long").alias("list_no"), query_key, key, *(F.lit(0.0).alias(c) for c in ("score", "coverage")), F.lit(0).cast("long").alias("hits"))


def relevant(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, key: str, text: Column, share: float = 0.3, least: int = 5, **how) -> DataFrame:
    """(query_key, key, score): what pruned() keeps of search_all(), in two passes over the texts where they lie."""
    asked, texts, w = _weighed_texts(queries, query_key, query_text, docs, key, text, **how)
    found = scan.relevant(asked, texts, w, query_key, key, share, least)
    return asked.crossJoin(texts).filter("false").select(query_key, key, F.lit(0.0).alias("score")) if found is None else found


def titles(asked: DataFrame, titles: DataFrame, query_key: str, key: str, least: float, precise: float, contained: float, rare: int, most: int) -> DataFrame:
    """(query_key, key, score, rank): titles (key, token) for queries (query_key, token), both distinct.

    Of a title's tokens that a query has, coverage weighs by ln(1 + N / df) against all of the query's, precision counts
    against all of the title's. A title of two hits counts if 0.7 coverage + 0.3 precision reaches least and precision
    precise, or if precision reaches contained and one of the hits is in no more than rare titles.
    """
    size = titles.groupBy(key).agg(F.count("*").alias("size"))
    n = size.agg(F.count("*").alias("n"))
    df = titles.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + F.col("n") / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    i = asked.join(df, "token", "left").join(F.broadcast(n)).select(query_key, "token", idf.alias("idf"), F.coalesce("df", F.lit(0)).alias("df"))
    total = i.groupBy(query_key).agg(F.sum("idf").alias("w_all"), F.count("*").alias("n_all")).filter("n_all >= 2")
    m = i.join(titles, "token").groupBy(query_key, key).agg(F.count("*").alias("c"), F.sum("idf").alias("w"), F.bool_or(F.col("df") <= rare).alias("is_rare")).filter("c >= 2")
    cov, prec = F.col("w") / F.col("w_all"), F.col("c") / F.col("size")
    score = cov * 0.7 + prec * 0.3
    kept_ones = m.join(total, query_key).join(size, key).filter(((score >= least) & (prec >= precise)) | ((prec >= contained) & F.col("is_rare")))
    return best(kept_ones.select(query_key, key, F.round(score, 6).alias("score")), query_key, [F.desc("score"), F.col(key)], most)


def best(found: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each query, with their rank; Spark limits each group before it shuffles."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def pruned(found: DataFrame, by: str, share: float = 0.3, least: int = 5) -> DataFrame:
    """Relevance cut-off: with enough full hits, or a one-token query, only these at a share of their best score; else
    those that cover half at a share of the best of all. A query of several tokens without any full hit loses all."""
    w = Window.partitionBy(by)
    full = F.col("hits") == F.col("asked")
    marked = found.withColumn("_full", full).withColumn("_n", F.count_if(full).over(w)).withColumn("_top", F.max("score").over(w)).withColumn("_top_full", F.max(F.when(full, F.col("score"))).over(w))
    strict = (F.col("_n") >= least) | (F.col("asked") == 1)
    kept = F.when((F.col("asked") > 1) & (F.col("_n") == 0), False).when(strict, F.col("_full") & (F.col("score") >= share * F.col("_top_full"))).otherwise((F.col("_full") | (F.col("coverage") >= 0.5)) & (F.col("score") >= share * F.col("_top")))
    return marked.filter(kept).drop("_full", "_n", "_top", "_top_full")


def round_robin(lists: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Fusion of ranked lists (list_no, rank from 0): round by round, the first time a key is seen counts, at most so many."""
    n = F.lit(1_000)
    first = lists.groupBy(by, key).agg(F.min(F.col("rank") * n + F.col("list_no")).alias("place"))
    return best(first, by, [F.col("place"), F.col(key)], most)


def group_rank(found: DataFrame, by: str, group: str) -> DataFrame:
    """Groups of ranked results by the sum of 1 / rank; ties to the smaller group."""
    scored = found.groupBy(by, group).agg(F.round(F.sum(1 / F.col("rank")), 4).alias("weight"), F.count("*").alias("n"))
    return scored.withColumn("group_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), group)))
