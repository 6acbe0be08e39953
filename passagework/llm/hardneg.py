"""Operator 12: hard negatives by a pivot table.

Vectors get one more component, so that the inner product with an anchor becomes a Euclidean distance: with M the greatest
length, (x, sqrt(M^2 - |x|^2)) and (q, 0) are |q|^2 + M^2 - 2 q.x apart, squared. A table of each row's distances to a
bounded number of pivots is stored. By the triangle inequality the anchor's and a row's distances to a pivot bracket the
distance between them, and with it the score from both sides: first for whole cells (the rows nearest to one pivot), which
decides where an anchor is sent, then for rows; survivors get their exact score.

A first pass over a block near the anchor gives scores that the winners must reach; the second pass goes to all cells that
may hold more. Rows are shuffled once for a pass and anchors stream past them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import past_blocks, vectors_of
from .common import drop_table, materialize, table
from .topk import valid

POSITIVES, NEGATIVES, LEAST, MOST, SCALE, EVERY = 5, 10, 30, 90, 256.0, 100
#: Pivots (and cells) at most, those whose distances are compared row by row, and the sample they are chosen from.
PIVOTS, ROW_PIVOTS, SAMPLE = 256, 8, 4096
ROWS = 65_536


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those before it; the first is the first."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(m: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors (m, extra) to augmented pivots."""
    square = (m**2).sum(1)[:, None] + (extra**2)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (m @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(square, 0))


class Space:
    """What a task must know of one vector length: the greatest square of a length, and the pivots."""

    def __init__(self, square: float, pivots: np.ndarray):
        self.square, self.pivots, self.slack = square, pivots, 1e-6 * (1 + square) ** 0.5

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of an anchor from a row whose product with it is score."""
        return np.sqrt(np.maximum((q**2).sum(1) + self.square - 2 * score, 0))


class Held:
    """A block of rows in order of id: ids, labels, vectors and pivot distances, and the places of each label."""

    def __init__(self, t: pa.Table):
        self.ids, self.labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        self.v, self.far, self.dim = vectors_of(t), vectors_of(t, "far"), t.column("dim")[0].as_py()
        self.of = {k: np.flatnonzero(self.labels == k) for k in np.unique(self.labels).tolist()}


def survivors(asking: np.ndarray, held: np.ndarray, near: np.ndarray, beyond: np.ndarray, slack: float) -> np.ndarray:
    """Which pairs may lie no farther apart than near and no closer than beyond, by their distances to the same pivots."""
    left = np.ones((len(asking), len(held)), bool)
    for p in range(held.shape[1]):
        a, b = asking[:, p : p + 1], held[None, :, p]
        left &= (np.abs(a - b) <= near[:, None] + slack) & (a + b >= beyond[:, None] - slack)
    return left


def first_places(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k greatest scores above minus infinity in each row, ties to the smaller place. Scores are whole."""
    n, fits = score.shape[1], np.isfinite(score)
    top = np.abs(score[fits]).max() if fits.any() else 0.0
    if top >= 2.0**62 / max(n, 1):
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]
    else:
        key = np.where(fits, score, 0).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        key[~fits] = np.iinfo(np.int64).min
        at = np.argpartition(~key, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), score.shape)
    row = np.repeat(np.arange(len(score)), at.shape[1])
    keep = fits[row, at.ravel()]
    return row[keep], at.ravel()[keep]


def prepared(vectors: DataFrame, label: Column, anchor: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, label, asks, v, dim): the rows that take part, components as floor(scale * x), one row of each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & valid(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("x")).select("id", "x.*", F.size("x.v").alias("dim"))


def hard_negatives(
    vectors: DataFrame, label: Column, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, per_block: int = ROWS, pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best other rows of the same label by integer product, its negatives for a positive the
    best rows of other labels between least and most hundredths of the positive's score. Ties go to the smaller id. Rows
    with a null id, label or vector, an empty vector or null or non-finite components take no part; rows of another
    vector length are no candidates. A zero vector is an ordinary one. Of rows that share an id, the one of the smallest
    label and then vector takes part. A band is empty where the positive's score is below 0. Products are exact while
    their terms stay below 2**53. Other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(prepared(vectors, label, anchor, id_col, vector_col, scale), "quantised")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    of_dim = {r.dim: (r.n, r.square) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()}  # a row for each vector length
    total, some = max(1, sum(n for n, _ in of_dim.values())), {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("id"), "dim").limit(SAMPLE).collect():  # SAMPLE rows at most
        some.setdefault(r.dim, []).append(r.v)
    block, spaces = max(256, min(per_block, -(-total // 96))), {}  # small tables are dealt to some hundred tasks as well
    for dim, (n, top) in of_dim.items():
        points = np.array(some.get(dim, [[0.0] * dim]))
        whole = np.column_stack([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))])
        spaces[dim] = Space(top, spread(whole, max(ROW_PIVOTS, min(pivots, -(-n // block)))))

    def measure(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own, space = batch.take(pa.array(np.flatnonzero(dims == dim))), spaces[dim]
                m = vectors_of(own)
                far = distances(m, np.sqrt(np.maximum(space.square - (m**2).sum(1), 0)), space.pivots)
                asking, asks = distances(m, np.zeros(len(m)), space.pivots[:ROW_PIVOTS]), own.column("asks").to_pylist()
                cells = pa.array(far.argmin(1), pa.int32())
                sides = [pa.array(list(far[:, :ROW_PIVOTS]), pa.list_(pa.float64())), pa.array([a if y else None for a, y in zip(asking, asks, strict=True)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*own.columns, cells, *sides], names=[*own.schema.names, "cell", "far", "asking"])

    measured = materialize(rows.mapInArrow(measure, "id long, label long, v array<double>, asks boolean, dim int, cell int, far array<double>, asking array<double>"), "pivot-table")
    drop_table(rows)
    ends = [f(F.get("far", F.lit(p))).alias(f"{name}{p}") for p in range(ROW_PIVOTS) for name, f in (("low", F.min), ("high", F.max))]
    reach: dict[int, list] = {}
    for r in measured.groupBy("dim", "cell").agg(F.count("*").alias("n"), *ends).collect():  # a row for each pivot
        k = min(ROW_PIVOTS, len(spaces[r.dim].pivots))
        reach.setdefault(r.dim, []).append((r.cell, -(-r.n // block), [r[f"low{p}"] for p in range(k)], [r[f"high{p}"] for p in range(k)]))
    subs = vectors.sparkSession.createDataFrame([(d, c, n) for d, cells in reach.items() for c, n, _, _ in cells], "dim int, cell int, subs int")

    placed = measured.join(F.broadcast(subs), ["dim", "cell"])  # a row for each pivot
    data = placed.select(F.concat_ws(":", "dim", "cell", F.pmod(F.xxhash64("id"), F.col("subs"))).alias("block"), F.lit(False).alias("asks"), "id", "label", "v", "dim", "far", F.array().cast("array<struct<positive_id: long, positive_score: long, low: double, high: double>>").alias("bands"))

    def sent(anchors: DataFrame) -> DataFrame:
        """Anchors (..., bands) to the blocks of all cells that may hold a row of theirs between their least low and greatest high."""

        def run(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own, space = batch.take(pa.array(np.flatnonzero(dims == dim))), spaces[dim]
                    q, asking, (near, beyond) = vectors_of(own), vectors_of(own, "far"), _limits(own, space)
                    low, high = (np.array([c[i] for c in reach[dim]]) for i in (2, 3))
                    least_far = np.maximum(low[None] - asking[:, None], asking[:, None] - high[None]).max(2)
                    most_far = (asking[:, None] + high[None]).min(2)
                    is_open = (least_far <= near[:, None] + space.slack) & (most_far >= beyond[:, None] - space.slack)
                    names = [[f"{dim}:{c[0]}:{s}" for c, y in zip(reach[dim], row, strict=True) if y for s in range(c[1])] for row in is_open.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), *own.columns], names=["blocks", *own.schema.names])
                    del q

        kind = "blocks array<string>, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
        return anchors.mapInArrow(run, kind).select(F.explode("blocks").alias("block"), F.lit(True).alias("asks"), "id", "label", "v", "dim", "far", "bands")

    def _limits(t: pa.RecordBatch, space: Space) -> tuple[np.ndarray, np.ndarray]:
        """(near, beyond): the distances between which an anchor's rows lie; without bands, all of them."""
        q, bands = vectors_of(t), t.column("bands").to_pylist()
        low = np.array([min((b["low"] for b in x), default=-np.inf) for x in bands])
        high = np.array([max((b["high"] for b in x), default=np.inf) for x in bands])
        return space.reach(q, low), np.where(np.isinf(high), 0, space.reach(q, np.where(np.isinf(high), 0, high)))

    def best_same(held: Held, batch: pa.RecordBatch):
        """Of a block, each anchor's best rows of the same label that reach its floor."""
        space, q, asking, ids, labels = spaces[held.dim], vectors_of(batch), vectors_of(batch, "far"), batch.column("id").to_numpy(), batch.column("label").to_numpy()
        near, beyond = _limits(batch, space)
        for label in np.unique(labels).tolist():
            places = held.of.get(label, np.zeros(0, int))
            for mine in _chunks(np.flatnonzero(labels == label), len(places)):
                left = survivors(asking[mine], held.far[places], near[mine], beyond[mine], space.slack) & (ids[mine][:, None] != held.ids[places][None, :])
                cols = np.flatnonzero(left.any(0))
                score = np.where(left[:, cols], q[mine] @ held.v[places[cols]].T, -np.inf)
                row, at = first_places(score, positives)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine][row]), pa.array(held.ids[places[cols[at]]]), pa.array(score[row, at].astype(np.int64))], names=["anchor_id", "positive_id", "positive_score"])

    def best_other(held: Held, batch: pa.RecordBatch):
        """Of a block, for each anchor and band the best rows of other labels inside it."""
        space, q, asking, ids, labels, bands = spaces[held.dim], vectors_of(batch), vectors_of(batch, "far"), batch.column("id").to_numpy(), batch.column("label").to_numpy(), batch.column("bands").to_pylist()
        near, beyond = _limits(batch, space)
        for mine in _chunks(np.arange(len(ids)), len(held.ids)):
            left = survivors(asking[mine], held.far, near[mine], beyond[mine], space.slack) & (labels[mine][:, None] != held.labels[None, :])
            cols = np.flatnonzero(left.any(0))
            score = np.where(left[:, cols], q[mine] @ held.v[cols].T, -np.inf)
            for i in range(max(len(bands[a]) for a in mine.tolist())):
                has = [j for j, a in enumerate(mine.tolist()) if i < len(bands[a])]
                band = [bands[mine[j]][i] for j in has]
                low, high = (np.array([b[k] for b in band])[:, None] for k in ("low", "high"))
                row, at = first_places(np.where((score[has] >= low) & (score[has] <= high), score[has], -np.inf), negatives)
                pick = [band[r] for r in row.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[mine[has]][row]), pa.array([b["positive_id"] for b in pick], pa.int64()), pa.array([b["positive_score"] for b in pick], pa.int64()),
                    pa.array(held.ids[cols[at]]), pa.array(score[np.array(has, int)[row], at].astype(np.int64)),
                ], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    def ranked(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    anchors = measured.filter("asks").select("id", "label", "v", "dim", F.col("asking").alias("far"), "cell")
    found_kind, no_band = "anchor_id long, positive_id long, positive_score long", F.array().cast("array<struct<positive_id: long, positive_score: long, low: double, high: double>>")
    near_by = anchors.select(F.concat_ws(":", "dim", "cell", F.lit(0)).alias("block"), F.lit(True).alias("asks"), "id", "label", "v", "dim", "far", no_band.alias("bands"))
    first = past_blocks(data.filter(F.col("block").endswith(":0")).unionByName(near_by), found_kind, Held, best_same)
    floor = first.groupBy(F.col("anchor_id").alias("id")).agg(F.when(F.count("*") == positives, F.min("positive_score").cast("double")).alias("low"))
    floored = anchors.join(floor, "id", "left").withColumn("bands", F.when(F.col("low").isNull(), no_band).otherwise(F.array(F.struct(F.col("id").alias("positive_id"), F.lit(0).cast("long").alias("positive_score"), "low", F.lit(float("inf")).alias("high")))))
    same = past_blocks(data.unionByName(sent(floored.select("id", "label", "v", "dim", "far", "bands"))), found_kind, Held, best_same)
    same = materialize(ranked(same, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    low, high = F.ceil(F.col("positive_score") * least / 100).cast("double"), F.floor(F.col("positive_score") * most / 100).cast("double")
    bands = same.withColumn("low", low).withColumn("high", high).filter("low <= high")
    bands = bands.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score", "low", "high")).alias("bands"))  # positives of an anchor at most
    asked = sent(anchors.join(bands, "id").select("id", "label", "v", "dim", "far", "bands"))
    other = past_blocks(data.unionByName(asked), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", Held, best_other)
    other = ranked(other, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return other.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _chunks(rows: np.ndarray, width: int, cells: int = 4_000_000) -> list[np.ndarray]:
    """The rows in pieces whose products with width others have a bounded number of cells; none if there are no others."""
    return np.array_split(rows, -(-len(rows) * width // cells)) if len(rows) and width else []


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of embeddings; nulls, repeated ids and odd vectors are as in hard_negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % EVERY == 0)


SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id AS other_id, a.label = d.label AS same, CAST(list_inner_product(a.e, d.e) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id AND len(a.e) = len(d.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
}
