"""Dense vectors: products, nearest neighbours, quantising, projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Product of two vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def quantise(v: Column, scale: float = 127.0) -> Column:
    """Unit length, then components times scale rounded half to even, within a byte."""
    byte = lambda x, n: F.greatest(F.lit(-scale), F.least(F.lit(scale), F.rint(x.cast("double") / n * scale))).cast("int")
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: byte(x, n)))[0]  # the length is taken once, not for each component


def rounded(x: Column, digits: int) -> Column:
    """A number to so many digits, halves away from zero, as SQL engines round doubles: a negative number that rounds to
    zero keeps its sign, and what is too large to be scaled stays as it is."""
    scaled = x * 10.0**digits
    near = F.round(scaled, 0) / 10.0**digits
    return F.when(F.abs(scaled) == float("inf"), x).when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)


def project(v: Column, seed: int, out: int) -> Column:
    """Product with a sign matrix that is computed, not stored: sign of (i * 31 + j * 17 + seed) mod 7 against 3. Components
    that are null count as absent; a vector without any other has no product."""
    sign = lambda i, j: F.when((i * 31 + j * 17 + seed) % 7 > 3, 1.0).otherwise(-1.0)

    def total(j: Column) -> Column:
        known = F.filter(F.transform(v, lambda x, i: x.cast("double") * sign(i, j)), lambda x: x.isNotNull())
        return F.aggregate(known, F.lit(None).cast("double"), lambda s, x: F.coalesce(s, F.lit(0.0)) + x, lambda s: rounded(s, 4))

    return F.transform(F.sequence(F.lit(0), F.lit(out - 1)), total)


def usable(v: Column) -> Column:
    """Vectors that are there, hold finite numbers only, and not only zeros."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(queries: DataFrame, rows: DataFrame, query_key: str, key: str, vector: str, k: int, per_block: int = 16_384, per_query_block: int = 8_192) -> DataFrame:
    """(query_key, key, score, rank): the k rows of greatest cosine for each query but itself, ties to the smaller key.

    Blocks of queries meet blocks of rows in tasks, as one matrix product each; a block yields its k best for each
    query, however many tie. A row goes out once for each block of queries. Vectors that are null, empty or zero or hold null
    or non-finite components take no part; vectors of another length are no candidates.
    """
    import numpy as np
    import pyarrow as pa

    rows, queries = (x.filter(usable(F.col(vector))) for x in (rows, queries))
    n_rows, n_queries = rows.count(), queries.count()
    blocks, q_blocks = max(1, -(-n_rows // per_block)), max(1, -(-n_queries // per_query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    dealt = rows.select(own(blocks).alias("b"), every(q_blocks).alias("q"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(False).alias("asks"), F.size(vector).alias("dim"))
    asked = queries.select(every(blocks).alias("b"), own(q_blocks).alias("q"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(True).alias("asks"), F.size(vector).alias("dim"))

    def best(t: pa.Table) -> pa.Table:
        m = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(ids[~asks], kind="stable")
        there, data, out = ids[~asks][order], m[~asks][order], []
        for at in range(0, int(asks.sum()), 512):
            q, names = m[asks][at : at + 512], ids[asks][at : at + 512]
            score = np.round(q @ data.T, 6)
            score[names[:, None] == there[None, :]] = -np.inf
            n = score.shape[1]  # rows stand by key, so a tie goes to the smaller place
            place = np.where(np.isfinite(score), np.rint(np.where(np.isfinite(score), score, 0) * 1e6) * n - np.arange(n), -np.inf)
            some = min(k, n)
            kth = -np.partition(-place, some - 1, axis=1)[:, some - 1 : some] if some else place
            row, col = np.nonzero((place >= kth) & np.isfinite(place))
            out.append(pa.table({query_key: pa.array(names[row]), key: pa.array(there[col]), "score": pa.array(score[row, col])}))
        return pa.concat_tables(out) if out else pa.table({query_key: pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = dealt.union(asked).groupBy("b", "q", "dim").applyInArrow(best, f"`{query_key}` long, `{key}` long, score double")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def principal(rows: DataFrame, vector: str, dim: int, out: int) -> list[list[float]]:
    """The first directions of the uncentred decomposition of unit vectors, greatest first: out lists of dim numbers.

    Each task sums the products of its components; only these matrices, dim by dim each, meet, and the sum comes to the
    driver. Vectors that are null, zero, of another length or hold null or non-finite components do not count. The
    largest component of a direction is positive.
    """
    import numpy as np
    import pyarrow as pa

    def sums(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(total.ravel())], names=["cell", "x"])

    v = rows.select(F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    cells = v.mapInArrow(sums, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()  # dim * dim numbers
    gram = np.zeros(dim * dim)
    for cell, x in cells:
        gram[cell] = x
    values, directions = np.linalg.eigh(gram.reshape(dim, dim))
    first = directions[:, np.argsort(-values)[:out]].T
    signs = np.sign(first[np.arange(len(first)), np.abs(first).argmax(axis=1)])
    return (first * signs[:, None]).tolist()


def onto(v: Column, directions: list[list[float]]) -> Column:
    """The products of a vector with each direction; null for a null vector or one of another length, not a number where a
    component is null. Vectors come in batches and are summed component by component, in the order that dot() has."""
    import numpy as np

    dim, matrix = len(directions[0]), np.array(directions, np.float64)

    def products(batch: pd.Series) -> pd.Series:
        whole = [k for k, r in enumerate(batch) if r is not None and len(r) == dim]
        m = np.array([np.asarray(batch.iloc[k], np.float64) for k in whole]).reshape(len(whole), dim)
        total, out = np.zeros((len(whole), len(matrix))), [None] * len(batch)
        for i in range(dim):
            total += m[:, i : i + 1] * matrix[:, i]
        for k, row in zip(whole, total, strict=True):
            out[k] = row
        return pd.Series(out, dtype=object)

    return F.pandas_udf(products, "array<double>")(v.cast("array<double>"))
