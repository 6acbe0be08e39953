"""Operator 4: near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if it lies in the cap around it. Directions are the words of a random
product code: one random unit vector in each of a few coordinate groups, so a vector's list of all filters above the
threshold is decoded from a few short tables of partial products. The threshold is one height for all vectors, or a
vector's own LISTED-th best direction where fewer lie above that height; with more vectors there are more codes, so
that near pairs keep meeting. Vectors meet in the filters that both pass; a filter's
vectors are compared in blocks, and each block yields a spanning set of its links, not all of them. Links then give
components, and inside a component every pair is compared in blocks to count links.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table, worker_cache
from .topk import valid

COSINE, CODES, GROUPS, LISTED, SEED, BLOCK = 0.9, 4, 4, 15, 20_240_101, 1024
#: Directions that a code has for each vector, and how many of them a random vector has above the common height.
DIRECTIONS, ABOVE = 64, 8


def words_for(n: int, groups: int = GROUPS) -> int:
    """Words of a coordinate group, so that a code has about DIRECTIONS directions for each of n vectors."""
    return max(16, int(np.ceil((DIRECTIONS * max(n, 1)) ** (1 / groups))))


def codes_for(n: int) -> int:
    """Codes that keep the share of pairs at the least cosine that meet above 0.95 for n vectors; see the tests."""
    return max(CODES, int(np.ceil(np.log2(max(n, 1)) / 2.5 - 3)))


def height_for(dim: int, words: int, groups: int = GROUPS) -> float:
    """The common threshold: products of a random unit vector are about normal, so a tail of that has ABOVE directions."""
    used = min(groups, dim)
    return float(NormalDist().inv_cdf(1 - min(0.5, ABOVE / words**used)) * np.sqrt(used / dim))


def codes(dim: int, words: int, groups: int = GROUPS, n: int = CODES, seed: int = SEED) -> list[tuple[np.ndarray, list]]:
    """For each code a random rotation, and for each of its coordinate groups the slice and the words."""
    key = "codes", dim, words, groups, n, seed
    if key not in worker_cache():
        rng, out = np.random.default_rng([seed, dim, words]), []
        cuts = np.linspace(0, dim, min(groups, dim) + 1).astype(int)
        for _ in range(n):
            turn, parts = np.linalg.qr(rng.standard_normal((dim, dim)))[0], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                w = rng.standard_normal((words, b - a))
                parts.append((slice(a, b), (w / np.linalg.norm(w, axis=1, keepdims=True)).T))
            out.append((turn, parts))
        worker_cache()[key] = out
    return worker_cache()[key]


def filters_of(unit: np.ndarray, words: int, n_codes: int = CODES, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter): all directions above a unit vector's threshold, of each code.

    The best directions come group by group: one that ranks below the listed best by its first groups cannot be among
    them. Where they all lie above the common height, all others above it are decoded too; a direction is given up as
    soon as the best words of the groups left cannot lift it that high.
    """
    rows, out, height = [], [], height_for(unit.shape[1], words)
    for c, (turn, parts) in enumerate(codes(unit.shape[1], words, n=n_codes)):
        turned = unit @ turn
        products = [turned[:, where] @ w for where, w in parts]
        total, number = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for p in products:
            total = (total[:, :, None] + p[:, None, :]).reshape(len(unit), -1)
            number = (number[:, :, None] * words + np.arange(words)).reshape(len(unit), -1)
            if total.shape[1] > listed:
                best = np.argpartition(-total, listed - 1, axis=1)[:, :listed]
                total, number = np.take_along_axis(total, best, 1), np.take_along_axis(number, best, 1)
        more = total.min(1) >= height
        few = np.flatnonzero(~more)
        rows.append(np.repeat(few, number.shape[1]))
        out.append(number[few].ravel() * n_codes + c)
        row = np.flatnonzero(more)
        total, number = np.zeros(len(row)), np.zeros(len(row), np.int64)
        rest = np.cumsum([p.max(1) for p in products][::-1], axis=0)[::-1]
        for g, p in enumerate(products):
            lift = rest[g + 1][row] if g + 1 < len(products) else 0.0
            at, word = np.nonzero(total[:, None] + p[row] + np.asarray(lift).reshape(-1, 1) >= height)
            row, total, number = row[at], total[at] + p[row[at], word], number[at] * words + word
        rows.append(row)
        out.append(number * n_codes + c)
    return np.concatenate(rows), np.concatenate(out)


def matrix(column) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(v), -1) if len(v) else np.zeros((0, 1))
    return m / np.abs(m).max(1, keepdims=True) if len(v) else m


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def labels_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row reachable."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(1)
        low = np.minimum(label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors link
    only with those of their length. Equal vectors are compared once, as a class. A repeated id counts as one more
    vector. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = rows.filter(valid(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    classes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "vector-classes")

    n_classes = classes.count()
    words, n_codes = words_for(n_classes), codes_for(n_classes)

    def decode(batches):
        for batch in batches:
            for dim in set(batch.column(1).to_pylist()):
                pick = np.flatnonzero(batch.column(1).to_numpy() == dim)
                ids = batch.column(0).to_numpy()[pick]
                for at in range(0, len(pick), 512):
                    row, number = filters_of(unit(matrix(batch.column(2).take(pa.array(pick[at : at + 512])))), words, n_codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim), pa.int32()), pa.array(number, pa.int64()), pa.array(ids[at : at + 512][row], pa.int64())], names=["dim", "filter", "rep"])

    passed = materialize(classes.select("rep", "dim", "v").mapInArrow(decode, "dim int, filter long, rep long"), "filters")
    shared = passed.groupBy("dim", "filter").agg(F.count("*").alias("n")).filter("n > 1")
    met = passed.join(shared, ["dim", "filter"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    met = met.select("dim", "filter", "rep", F.explode(pairs).alias("p")).select("dim", "filter", "p.i", "p.j", "rep")
    met = met.join(classes.select("rep", "v"), "rep").repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")

    def compare(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([t.column(k).to_numpy() for k in ("dim", "filter", "i", "j")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield from links(t.slice(0, last), cut[:-1])
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from links(held, np.zeros(0, int))

    def links(t: pa.Table, cut: np.ndarray):
        out = []
        ids, v = t.column("rep").to_numpy(), t.column("v").combine_chunks()
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True):
            if b - a > 1:
                u = unit(matrix(v.slice(a, b - a)))
                label = labels_of(u @ u.T >= cosine)
                out += [(int(ids[a + i]), int(ids[a + j])) for i, j in enumerate(label.tolist()) if i != j]
        if out:
            x, y = zip(*set(out), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    edges = met.select("dim", "filter", "i", "j", "rep", "v").mapInArrow(compare, "a long, b long")
    component = materialize(connected_components(spark, edges), "components")
    sized = component.join(component.groupBy("component").agg(F.count("*").alias("n")), "component").withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    ordered = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(True).alias("asks")))
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks")))
    dealt = sized.select("component", F.col("node").alias("rep"), F.explode(F.concat(ordered, other)).alias("p")).select("component", "p.*", "rep")
    dealt = dealt.join(classes.select("rep", "v", "copies"), "rep")

    def count(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        u, ids, copies = unit(matrix(t.column("v"))), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        linked = u[asks] @ u[~asks].T >= cosine
        linked &= ids[asks][:, None] != ids[~asks][None, :]
        return pa.table({"rep": pa.array(ids[asks], pa.int64()), "links": pa.array(linked @ copies[~asks], pa.int64())})

    counted = dealt.groupBy("component", "i", "j").applyInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    per_class = per_class.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(per_class, "v", "left")
    usable = F.col("vec_id").isNotNull()
    n, c = F.when(usable, F.coalesce("n", F.lit(0))).otherwise(0), F.when(usable, F.coalesce("c", "vec_id"))
    return out.select("vec_id", n.cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(F.col("vec_id") == c, F.lit(True)).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = {
    "op4_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN degree d ON e.vec_id = d.a
"""
}
