"""Operator 6: exact top-k search by inner product, with cover trees over queries and data.

The upper level of both trees is a table of cells: vectors belong to the nearest of a bounded number of pivots, and a
cell has a covering radius. A first pass compares each cell of queries with the data around its own pivot, which gives
every query a kth score to beat; then only pairs of cells that can still hold a winner are dealt out. A task holds a block
of a cell of either kind, builds a cover tree of both and walks pairs of nodes in the same way: a pair is dropped when
its greatest possible product, from the centres' product and the covering radii, is below the worst kth score of its
queries. The blocks' winners meet in a ranking per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K, EVERY, SCALE, QUERIES, ROWS = 5, 50, 256.0, 1024, 8192
LEAF, FANOUT = 64, 256
#: Pivots at most; what reaches the driver is a row for each of them (and for each vector length).
PIVOTS = 2048


def valid(v: Column) -> Column:
    """Vectors that are there, not empty, and hold finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)


def matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The vectors v of a table, all of one length."""
    v = t.column("v").combine_chunks() if isinstance(t, pa.Table) else t.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


class Tree:
    """A cover tree: nodes (centre, radius, rows of points held here, child nodes). A child's radius is at most half its parent's."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple[np.ndarray, float, np.ndarray, list[int]]] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _build(self, rows: np.ndarray, centre: int) -> int:
        at, c = len(self.nodes), self.points[rows[centre]]
        radius = float(np.sqrt(((self.points[rows] - c) ** 2).sum(1).max()))
        self.nodes.append((c, radius, rows, []))
        if len(rows) <= LEAF or radius == 0:
            return at
        rest, alone, children = rows, [], []
        for _ in range(FANOUT):
            if not len(rest):
                break
            near = ((self.points[rest] - self.points[rest[0]]) ** 2).sum(1) <= (radius / 2) ** 2
            group, rest = rest[near], rest[~near]
            if len(group) > LEAF // 4:
                children.append(self._build(group, 0))
            else:
                alone.append(group)
        self.nodes[at] = (c, radius, np.concatenate([*alone, rest]) if alone or len(rest) else rest, children)
        return at


def bound(a: tuple, b: tuple) -> float:
    """The greatest possible product of vectors of two nodes (centre, radius ...)."""
    na, nb = np.linalg.norm(a[0]), np.linalg.norm(b[0])
    top = float(a[0] @ b[0]) + a[1] * nb + b[1] * na + a[1] * b[1]
    return top + 1e-9 * (abs(top) + 1)


def search(queries: np.ndarray, ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data id, score) of each query's k best rows by inner product, ties to the smaller id, itself left out.

    floor: a score for each query below which no row can be among its k best.
    """
    best = np.full((len(queries), k), -np.inf)
    if floor is not None:
        best[:] = floor[:, None]
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    left, right = Tree(queries), Tree(data)

    def under(tree: Tree, n: int) -> np.ndarray:
        rows = [tree.nodes[n][2], *(under(tree, c) for c in tree.nodes[n][3])]
        return np.unique(np.concatenate(rows))

    def base(rows: np.ndarray, cols: np.ndarray) -> None:
        if not len(rows) or not len(cols):
            return
        for at in range(0, len(cols), 4096):
            part = cols[at : at + 4096]
            score = queries[rows] @ data[part].T
            score[ids[rows][:, None] == data_ids[part][None, :]] = -np.inf
            if score.shape[1] > k:  # all that reach the kth score, ties included, compete
                kth = np.maximum(np.partition(score, -k, axis=1)[:, -k], best[rows].min(1))
            else:
                kth = np.full(len(rows), -np.inf)
            for r, c in zip(rows.tolist(), (score >= kth[:, None]) & (score > -np.inf), strict=True):
                hit = np.flatnonzero(c)
                if len(hit):
                    i = int(np.searchsorted(rows, r))
                    s = np.concatenate([best[r], score[i, hit]])
                    d = np.concatenate([best_id[r], data_ids[part[hit]]])
                    order = np.lexsort((d, -s))[:k]
                    best[r], best_id[r] = s[order], d[order]

    inside = {n: under(left, n) for n in range(len(left.nodes))}

    def walk(n: int, m: int, direct: bool) -> None:
        """direct: of node n only the queries held there, not those of its children."""
        a, b = left.nodes[n], right.nodes[m]
        rows = np.unique(a[2]) if direct else inside[n]
        if not len(rows) or bound(a, b) < best[rows].min():
            return
        if not direct and a[3] and (a[1] >= b[1] or not b[3]):  # split the wider node
            walk(n, m, True)
            for child in a[3]:
                walk(child, m, False)
            return
        base(rows, np.unique(b[2]))
        for child in sorted(b[3], key=lambda x: -bound(a, right.nodes[x])):
            walk(n, child, direct)

    if len(queries) and len(data):
        walk(0, 0, False)
    row, col = np.nonzero(best_id < np.iinfo(np.int64).max)
    return row, best_id[row, col], best[row, col]


def top_k(vectors: DataFrame, query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, per_block: int = ROWS, per_query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by the product of floor(scale * x).

    Null vectors, empty ones and those with null or non-finite components take no part; vectors of another length are no
    candidates. Rows that share an id are never each other's candidates; of repeated rows a candidate counts once for
    each query. Products are exact while their terms stay below 2**53, which doubles hold; beyond that scores saturate
    as doubles do. Ties go to the smaller id. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & valid(F.col("v")))
    rows = rows.select("id", "is_query", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))
    rows = materialize(rows.dropDuplicates(["id", "v"]).withColumn("dim", F.size("v")), "quantised")
    n, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    some = rows.select("dim", "v").orderBy(F.xxhash64("id"), "dim").limit(max(1, min(PIVOTS, -(-n // per_block)))).collect()
    pivots = {dim: np.array([r.v for r in some if r.dim == dim]) for dim in {r.dim for r in some}}
    most_query_cells = max(1, -(-asked // per_query_block))

    def centres(dim: int) -> np.ndarray:
        return pivots.get(dim, np.zeros((1, dim)))

    def nearest(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(m, -(-len(m) // 4096))])
        return at, np.sqrt(((m - c[at]) ** 2).sum(1))

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                m, c = matrix(own), centres(dim)
                found = [*nearest(m, c), *nearest(m, c[:most_query_cells])]
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, t) for x, t in zip(found, (pa.int32(), pa.float64()) * 2, strict=True))], names=[*own.schema.names, "cell", "far", "q_cell", "q_far"])

    placed = materialize(rows.mapInArrow(place, "id long, is_query boolean, v array<double>, dim int, cell int, far double, q_cell int, q_far double"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / per_block).alias("subs"), F.max("far").alias("radius"))
    q_cells = placed.filter("is_query").groupBy("dim", "q_cell").agg(F.ceil(F.count("*") / per_query_block).alias("q_subs"), F.max("q_far").alias("q_radius"))
    radius = {(r.dim, r.cell): r.radius for r in cells.collect()}
    q_radius = {(r.dim, r.q_cell): r.q_radius for r in q_cells.collect()}
    cells, q_cells = F.broadcast(cells.select("dim", "cell", "subs")), F.broadcast(q_cells.select("dim", "q_cell", "q_subs"))  # as many rows as pivots
    data = placed.join(cells, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id"), F.col("subs")).alias("sub"), "id", "v")
    queries = placed.filter("is_query").join(q_cells, ["dim", "q_cell"]).select("dim", "q_cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("q_subs")).alias("q_sub"), "id", "v")
    numbered = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def one(t: pa.Table) -> pa.Table:
        m, ids, asks = matrix(t), t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        row, found, score = search(m[asks], ids[asks], m[~asks], ids[~asks], k, t.column("floor").to_numpy(zero_copy_only=False)[asks])
        score = np.clip(score, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        return pa.table({"query_id": pa.array(ids[asks][row], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    found_kind, none = "query_id long, vec_id long, score long", F.lit(float("-inf"))
    key = ["dim", "q_cell", "q_sub", "cell", "sub"]
    near = data.filter("sub = 0").withColumn("q_cell", F.col("cell")).join(q_cells, ["dim", "q_cell"]).withColumn("q_sub", numbered("q_subs"))
    asked_near = queries.withColumn("cell", F.col("q_cell")).withColumn("sub", F.lit(0).cast("long"))
    both = near.select(*key, "id", "v", F.lit(False).alias("asks"), none.alias("floor")).union(asked_near.select(*key, "id", "v", F.lit(True), none))
    first = both.groupBy(*key).applyInArrow(one, found_kind)
    floor = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("floor"))
    queries = materialize(queries.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", none)), "queries")

    def open_pairs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = centres(r["dim"])[r["q_cell"]], q_radius[r["dim"], r["q_cell"]]
                left = [c for c, b in enumerate(centres(r["dim"])) if (r["dim"], c) in radius and bound(a, (b, radius[r["dim"], c])) >= r["floor"]]
                yield pa.RecordBatch.from_pylist([{"dim": r["dim"], "q_cell": r["q_cell"], "q_sub": r["q_sub"], "cell": c} for c in left], schema=pa.schema([("dim", pa.int32()), ("q_cell", pa.int32()), ("q_sub", pa.int64()), ("cell", pa.int32())]))

    groups = queries.groupBy("dim", "q_cell", "q_sub").agg(F.min("floor").alias("floor"))
    pairs = materialize(groups.mapInArrow(open_pairs, "dim int, q_cell int, q_sub long, cell int"), "open-pairs")
    asks = queries.join(pairs, ["dim", "q_cell", "q_sub"]).join(cells, ["dim", "cell"]).withColumn("sub", numbered("subs"))
    open_data = data.join(pairs, ["dim", "cell"]).select(*key, "id", "v", F.lit(False).alias("asks"), none.alias("floor"))
    dealt_out = open_data.union(asks.select(*key, "id", "v", F.lit(True), "floor"))
    found = dealt_out.groupBy(*key).applyInArrow(one, found_kind).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = {
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
}
