"""Hierarchies held as (id, parent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def ancestors(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(id, ancestor, depth): every node with itself and all nodes above it, up to so many levels or all of them; parents
    that are no nodes end a path. Cycles end at the bound; without one they are an error.

    Pointers are doubled: each round joins the table of steps of 2**k levels with itself, so there are as many rounds as
    the depth has binary digits, and the paths are put together from these tables.
    """
    ids = nodes.select("id").filter("id is not null")
    up = kept(nodes.select("id", F.col("parent").alias("to")).filter("id is not null").join(ids.select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("id", "to"), "steps")
    n, steps = ids.count(), []
    while not up.isEmpty() and (most is None or 1 << len(steps) <= most):
        if 1 << len(steps) > n:  # no path without a cycle is that long
            raise ValueError("the parents form a cycle")
        steps.append(up)
        up = kept(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")), "steps")
    found = ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    for k, step in enumerate(steps):
        far = step.join(found.select(F.col("id").alias("to"), "ancestor", (F.col("depth") + F.lit(1 << k)).alias("depth")), "to").select("id", "ancestor", "depth")
        found = kept(found.union(far), "paths")
    return found if most is None else found.filter(F.col("depth") <= most)


def _steps(nodes: DataFrame):
    """Tables (id, to) of the nodes 1, 2, 4 ... levels above; parents that are no nodes end a path. Cycles are an error."""
    ids = nodes.select("id").filter("id is not null")
    up = kept(nodes.select("id", F.col("parent").alias("to")).filter("id is not null").join(ids.select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("id", "to"), "steps")
    n, length = ids.count(), 1
    while not up.isEmpty():
        if length > n:  # no path without a cycle is that long
            raise ValueError("the parents form a cycle")
        yield length, up
        up, length = kept(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")), "steps"), 2 * length


def _lifted(nodes: DataFrame, start: DataFrame, join) -> DataFrame:
    """start has id and column x, what a node knows of itself. In each round it learns what the node 2**k levels above knows
    of as many levels: x becomes join(its own, the other's, the levels between). There are as many rounds as the depth has
    binary digits, and each writes a row for each node."""
    for length, up in _steps(nodes):
        above = up.join(start.select(F.col("id").alias("to"), F.col("x").alias("_x")), "to").select("id", "_x", F.lit(True).alias("_has"))
        both = start.join(above, "id", "left")
        start = kept(both.select("id", F.when(F.col("_has"), join(F.col("x"), F.col("_x"), length)).otherwise(F.col("x")).alias("x")), "lifted")
    return start


def depths(nodes: DataFrame) -> DataFrame:
    """(id, depth): levels above each node; ids are unique."""
    start = nodes.select("id").filter("id is not null").withColumn("x", F.lit(0).cast("long"))
    return _lifted(nodes, start, lambda own, above, length: above + length).select("id", F.col("x").cast("int").alias("depth"))


def paths(nodes: DataFrame, sign: str = "/") -> DataFrame:
    """(id, path): the ids from the root down to each node."""
    start = nodes.select("id").filter("id is not null").withColumn("x", F.col("id").cast("string"))
    return _lifted(nodes, start, lambda own, above, length: F.concat_ws(sign, above, own)).withColumnRenamed("x", "path")


def nearest_above(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, ancestor, depth) for each node with a marked node (id) above it: the nearest one."""
    mark = marked.select("id").distinct().withColumn("_m", F.lit(True))
    kind = nodes.schema["id"].dataType.simpleString()
    start = nodes.select("id").filter("id is not null").join(mark, "id", "left").select("id", F.when(F.col("_m"), F.struct(F.col("id").alias("ancestor"), F.lit(1).cast("long").alias("depth"))).alias("x"))
    found = _lifted(nodes, start, lambda own, above, length: F.coalesce(own, F.when(above.isNotNull(), F.struct(above["ancestor"].cast(kind).alias("ancestor"), (above["depth"] + length).alias("depth")))))
    over = nodes.filter("id is not null").select("id", F.col("parent").alias("p")).join(found.select(F.col("id").alias("p"), "x"), "p").filter("x is not null")
    return over.select("id", "x.ancestor", F.col("x.depth").cast("int").alias("depth"))


def subtrees(nodes: DataFrame) -> DataFrame:
    """(id, size, height) of the subtree of each node.

    A node first knows itself; in each round it adds what the nodes 2**k levels below it know of as many levels.
    """
    now = nodes.select("id").filter("id is not null").select("id", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("height"))
    for length, up in _steps(nodes):
        below = up.join(now, "id").groupBy(F.col("to").alias("id")).agg(F.sum("size").alias("_s"), (F.max("height") + length).alias("_h"))
        both = now.join(below, "id", "left")
        now = kept(both.select("id", (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), F.greatest("height", F.coalesce("_h", F.lit(0))).alias("height")), "subtrees")
    return now


def walked(nodes: DataFrame, roots: DataFrame, by: str, most: int, max_rounds: int = 200) -> DataFrame:
    """(by, id, path): the nodes that walks from each list of roots (by, id, place) visit, depth first, children by id, down
    to most levels below a root; path has the root's place and then the ids below it. A walk visits a node once and does
    not go on below one that was visited before.

    A frontier: in each round a node's path is the least of its own as a root and its parent's with its id, and the rounds
    end when no path changes. Rows are visited nodes, never pairs of nodes.
    """
    own = kept(roots.groupBy(by, "id").agg(F.min(F.array(F.col("place").cast("long"))).alias("path")), "roots")
    children = nodes.filter("id is not null and parent is not null").select(F.col("parent").alias("p"), F.col("id").alias("c"))
    now, seen = own, None
    for _ in range(max_rounds):
        via = now.filter(F.size("path") <= most).join(children, F.col("id") == F.col("p")).select(by, F.col("c").alias("id"), F.concat("path", F.array(F.col("c").cast("long"))).alias("path"))
        now = kept(own.union(via).groupBy(by, "id").agg(F.min("path").alias("path")), "walked")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(by, "id", "path").cast("decimal(38,0)"))).first())
        if state == seen:
            return now
        seen = state
    raise RuntimeError("the walks did not settle")


def first_reach(walks: DataFrame, members: DataFrame, by: str, cap: int) -> DataFrame:
    """(by, id, own, n, place, member): members (id, member) of walked nodes, each in the first group that a walk meets; groups
    of roots first, then larger ones, then as walked; of all members the first cap in this order, ties by member."""
    met = walks.join(members.distinct(), "id").groupBy(by, "member").agg(F.min(F.struct("path", "id")).alias("g"))
    met = met.select(by, "member", "g.path", "g.id")
    groups = met.groupBy(by, "id").agg(F.count("*").alias("n"), F.first("path").alias("path")).withColumn("own", F.size("path") == 1)
    order = Window.partitionBy(by).orderBy(F.desc("own"), F.desc("n"), "path")
    groups = groups.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("place", F.row_number().over(order)).filter(F.col("before") < cap)
    inside = met.join(groups.select(by, "id", "own", "n", "before", "place"), [by, "id"])
    inside = inside.withColumn("_r", F.row_number().over(Window.partitionBy(by, "id").orderBy("member"))).filter(F.col("_r") <= cap)
    return inside.filter(F.col("before") + F.col("_r") <= cap).select(by, "id", "own", "n", "place", "member")


def children(nodes: DataFrame, parents: DataFrame, parent: str, key: str, follows: Column, most: int) -> DataFrame:
    """(the columns of parents, children, n, strayed, linked): of each parent its first children by key, most at most, their
    number, how many do not follow it, and whether all do. Children without a parent row come under it all the same."""
    both = nodes.join(parents, parent, "left").withColumn("_f", follows)
    heads = [c for c in parents.columns if c != parent]
    counts = both.groupBy(parent, *heads).agg(F.count("*").alias("n"), F.count_if(~F.col("_f")).alias("strayed"))
    first = nodes.withColumn("_r", F.row_number().over(Window.partitionBy(parent).orderBy(key))).filter(F.col("_r") <= most)
    lists = first.groupBy(parent).agg(F.array_sort(F.collect_list(key)).alias("children"))
    return counts.join(lists, parent).withColumn("linked", F.col("strayed") == 0)
