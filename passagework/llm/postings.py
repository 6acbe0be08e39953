"""Operator 13: approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample in two levels: cuts at the median make lists of even size. They are searched by a
graph in memory: each centroid knows its nearest others, and a search starts from a few entries and expands whatever lies
within a ratio of the best distance. A vector goes to its nearest list and, at a boundary, to further ones whose centroids
are about as near and lie in other directions. A query reads the lists whose centroids lie within a ratio of the nearest
one's distance; the ratio is set by what a bounded sample of queries, searched exactly, would have needed.

Each list is dealt to blocks of bounded size, which tasks hold while queries stream past.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import past_blocks, vectors_of
from .common import materialize, table
from .topk import valid

K, EVERY, TARGET = 10, 100, 0.97
#: Rows a list should have, centroids at most (the graph's size bound), and the most rows that a task holds.
LISTED, CENTROIDS, ROWS = 256, 16_384, 65_536
#: Rows that the centroids are fitted on for each of them (about), and queries that set the ratio.
FITTED, TRIED = 16, 128
#: A boundary vector's further lists: how much farther their centroids may be, how far from those of its other lists
#: (as a share of their own distance), and lists at most. Neighbours of a centroid in the graph.
BOUNDARY, APART, COPIES, DEGREE = 1.1, 0.5, 4, 24


def bisected(points: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n centroids: the points are cut at the median, along the line between two means, until each part has its share."""
    if n <= 1 or len(points) < 2:
        return points.mean(0, keepdims=True)
    ends = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(6):
        along = points @ (ends[0] - ends[1])
        cut = np.quantile(along, 0.5)
        upper = along > cut
        if not upper.any() or upper.all():
            break
        ends = np.stack([points[upper].mean(0), points[~upper].mean(0)])
    order, left = np.argsort(points @ (ends[0] - ends[1]), kind="stable"), n // 2
    at = round(len(points) * left / n)
    return np.concatenate([bisected(points[order[:at]], left, rng), bisected(points[order[at:]], n - left, rng)])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


class Graph:
    """Centroids, each with its nearest others, and entries spread over them."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c, n = centroids, len(centroids)
        near = [np.argsort(squares(centroids[at : at + 512], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for at in range(0, n, 512)]
        self.next = np.concatenate(near) if n > 1 else np.zeros((n, 0), int)
        self.entries = np.arange(0, n, max(1, int(n**0.5)))

    def search(self, q: np.ndarray, ratio: float, width: int = 8) -> np.ndarray:
        """Distances (query by centroid) of the centroids that were met, infinite for others.

        Expanded is what lies within ratio of the best distance, or among the width nearest, until nothing new does.
        """
        out = np.full((len(q), len(self.c)), np.inf)
        out[:, self.entries] = np.sqrt(squares(q, self.c[self.entries]))
        done = np.zeros(out.shape, bool)
        length = (q**2).sum(1), (self.c**2).sum(1)
        while True:
            near = np.partition(out, min(width, out.shape[1]) - 1, axis=1)[:, min(width, out.shape[1]) - 1]
            row, node = np.nonzero(~done & (out <= np.maximum(near, ratio * out.min(1))[:, None]) & np.isfinite(out))
            if not len(row):
                return out
            done[row, node] = True
            fresh = np.zeros(out.shape, bool)
            fresh[np.repeat(row, self.next.shape[1]), self.next[node].ravel()] = True
            row, node = np.nonzero(fresh & np.isinf(out))
            for at in range(0, len(row), 65_536):
                r, c = row[at : at + 65_536], node[at : at + 65_536]
                out[r, c] = np.sqrt(np.maximum(length[0][r] + length[1][c] - 2 * np.einsum("ij,ij->i", q[r], self.c[c]), 0))

    def lists(self, v: np.ndarray, boundary: float = BOUNDARY, copies: int = COPIES) -> list[list[int]]:
        """Each vector's lists: the nearest, and others within the boundary whose centroids are not close to those chosen."""
        far, out = self.search(v, boundary), []
        order = np.argsort(far, axis=1, kind="stable")[:, : copies * 4]
        for row, near in zip(far, order.tolist(), strict=True):
            chosen: list[int] = []
            for c in near:
                if len(chosen) == copies or row[c] > boundary * row[near[0]]:
                    break
                if all(((self.c[c] - self.c[o]) ** 2).sum() > (APART * row[c]) ** 2 for o in chosen):
                    chosen.append(c)
            out.append(chosen or near[:1])
        return out


class Held:
    """A block of rows, equal ones once; most is how often an id comes with different vectors."""

    def __init__(self, t: pa.Table):
        ids, v = t.column("id").to_numpy(), vectors_of(t)
        order = np.lexsort((*v.T[::-1], ids))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (v[order][1:] != v[order][:-1]).any(1)
        self.ids, self.v = ids[order][new], v[order][new]
        self.square, self.most = (self.v**2).sum(1), int(np.unique(self.ids, return_counts=True)[1].max())


def nearest_held(k: int):
    def ask(held: Held, batch: pa.RecordBatch):
        """Each query's k nearest ids of a block, with distances summed from the components' differences."""
        ids, q = batch.column("id").to_numpy(), vectors_of(batch)
        for mine in np.array_split(np.arange(len(q)), -(-len(q) * len(held.ids) // 4_000_000)):
            length = (q[mine] ** 2).sum(1)[:, None]
            about = length + held.square[None, :] - 2 * q[mine] @ held.v.T
            about[ids[mine][:, None] == held.ids[None, :]] = np.inf
            at = min(k * held.most, about.shape[1]) - 1
            near = about <= np.partition(about, at, axis=1)[:, at : at + 1] + 1e-9 * (length + held.square.max())
            row, col = np.nonzero(near & np.isfinite(about))
            score = np.sqrt(((q[mine][row] - held.v[col]) ** 2).sum(1))
            order = np.lexsort((held.ids[col], score, row))
            row, col, score = row[order], held.ids[col[order]], score[order]
            first = np.zeros(len(row), bool)
            first[np.unique(np.stack([row, col]), axis=1, return_index=True)[1]] = True
            row, col, score = row[first], col[first], score[first]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[mine][row[keep]], pa.int64()), pa.array(col[keep], pa.int64()), pa.array(score[keep], pa.float64())], names=["query_id", "vec_id", "score"])

    return ask


FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim, asks): rows with an id and a vector of finite components, not all of them zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    return rows.filter(F.col("id").isNotNull() & valid(F.col("v")) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def fit(rows: DataFrame, listed: int = LISTED, most: int = CENTROIDS, fitted: int = FITTED) -> dict[int, Graph]:
    """A graph of centroids for each vector length, fitted on the rows of least hash: fitted of them for each centroid."""
    out, steps = {}, 1 << 24
    for dim, n in rows.groupBy("dim").count().collect():  # a row for each vector length
        wanted = int(max(1, min(most, -(-n // listed))))
        share = min(steps, -(-steps * wanted * fitted // n))
        some = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(steps)) < share)).select("v").limit(2 * wanted * fitted).toArrow()
        points = vectors_of(some if some.num_rows else rows.filter(F.col("dim") == dim).select("v").limit(wanted * fitted).toArrow())
        out[dim] = Graph(bisected(points, wanted, np.random.default_rng(dim)))
    return out


def index(rows: DataFrame, graphs: dict[int, Graph], copies_kept: int) -> DataFrame:
    """(id, v, dim, lists), written: the vectors with the lists that they are posted to.

    Of equal vectors the rows of the copies_kept smallest ids stand for all: no query has another among its nearest.
    """
    copy = F.dense_rank().over(Window.partitionBy("dim", "v").orderBy("id"))
    first = rows.select("id", "v", "dim").withColumn("copy", copy).filter(F.col("copy") <= copies_kept).drop("copy")

    def post(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, own.num_rows, 1024):
                    part = own.slice(at, 1024)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(graphs[dim].lists(vectors_of(part)), pa.list_(pa.int32()))], names=[*part.schema.names, "lists"])

    kind = rows.schema["v"].dataType.simpleString()
    return materialize(first.mapInArrow(post, f"id long, v {kind}, dim int, lists array<int>"), "postings")


def ratio_needed(rows: DataFrame, posted: DataFrame, graphs: dict[int, Graph], k: int, tried: int = TRIED, target: float = TARGET) -> float:
    """The least ratio of centroid distances at which a sample of queries finds the target share of its true neighbours.

    The sample's queries, tried of least hash, meet every row in blocks; a neighbour needs the ratio of its nearest list.
    """
    by_dim: dict[int, list] = {}
    for r in rows.filter("asks").orderBy(F.xxhash64("id"), "id").limit(tried).select("id", "v", "dim").collect():
        by_dim.setdefault(r.dim, []).append(r)
    ask = nearest_held(k)

    def scan(batches):
        asked = {d: pa.RecordBatch.from_arrays([pa.array([r.id for r in some], pa.int64()), pa.array([r.v for r in some])], names=["id", "v"]) for d, some in by_dim.items()}
        far = {(d, r.id): graphs[d].search(np.array([r.v], np.float64), np.inf)[0] for d, some in by_dim.items() for r in some}
        for batch in batches:
            for dim, queries in asked.items():
                own = batch.take(pa.array(np.flatnonzero(batch.column("dim").to_numpy() == dim)))
                if own.num_rows:
                    lists = dict(zip(own.column("id").to_pylist(), own.column("lists").to_pylist(), strict=True))
                    for part in ask(Held(pa.Table.from_batches([own])), queries):
                        pairs = zip(part.column("query_id").to_pylist(), part.column("vec_id").to_pylist(), strict=True)
                        need = [float(far[dim, a][lists[b]].min() / max(far[dim, a].min(), 1e-300)) for a, b in pairs]
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(need, pa.float64())], names=[*part.schema.names, "need"])

    if not by_dim:
        return 1.0
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = posted.mapInArrow(scan, FOUND + ", need double").withColumn("rank", rank).filter(F.col("rank") <= k)
    needs = sorted(r.need for r in best.select("need").collect())  # k rows for each query of the sample
    return needs[min(len(needs) - 1, int(np.ceil(target * len(needs))))] if needs else 1.0


def nearest(vectors: DataFrame, query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", listed: int = LISTED, most: int = CENTROIDS, per_block: int = ROWS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query's nearest other rows by Euclidean distance, those that its lists hold.

    Vectors that are null, empty or zero or hold null or non-finite components take no part; vectors of another length are
    no candidates. Rows that share an id are never each other's; of repeated candidates the nearest counts, and rows that
    share an id ask as one query with the nearest of their candidates. Ties go to the smaller id. The target is the share
    of true neighbours found on the sample. Other columns are ignored; an empty table gives an empty result.
    """
    rows = usable(vectors, query, id_col, vector_col)
    graphs = fit(rows, listed, most)
    posted = index(rows, graphs, k + 1)
    ratio = ratio_needed(rows, posted, graphs, k, target=target)
    each = posted.select("dim", F.explode("lists").alias("list"), "id", "v")
    subs = {(r.dim, r.list): -(-r.n // per_block) for r in each.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}  # a row for each centroid
    sized = F.broadcast(vectors.sparkSession.createDataFrame([(*key, n) for key, n in subs.items()], "dim int, list int, subs int"))
    data = each.join(sized, ["dim", "list"]).select(F.concat_ws(":", "dim", "list", F.pmod(F.xxhash64("id"), F.col("subs"))).alias("block"), F.lit(False).alias("asks"), "id", "v")

    def send(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, own.num_rows, 256):
                    part = own.slice(at, 256)
                    far = graphs[dim].search(vectors_of(part), ratio)
                    wanted = far <= far.min(1, keepdims=True) * ratio * (1 + 1e-12)
                    blocks = [[f"{dim}:{c}:{s}" for c in np.flatnonzero(row).tolist() for s in range(subs.get((dim, c), 0))] for row in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.list_(pa.string())), part.column("id"), part.column("v")], names=["blocks", "id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    asked = rows.filter("asks").select("id", "v", "dim").mapInArrow(send, f"blocks array<string>, id long, v {kind}")
    asked = asked.select(F.explode("blocks").alias("block"), F.lit(True).alias("asks"), "id", "v")
    found = past_blocks(data.unionByName(asked), FOUND, Held, nearest_held(k)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every hundredth row of embeddings; nulls, repeats, odd vectors and empty tables are as in nearest."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
