"""Operator 11: a Merkle manifest of a dataset, with proofs by coordinate lookup.

Leaves are numbered within their group by ranges: rows are sorted in range partitions, and prefix sums of the partitions'
counts give every leaf its index, so no group is sorted in one task. The tree grows in tiers of a few levels: a block of
neighbouring nodes is folded in one group of bounded size, and all its nodes are written with their coordinates (group,
level, index). The groups' roots are the leaves of one more tree of the same kind.

A proof is looked up: from its index and its group's size a leaf knows the coordinates of all siblings up to its block's
top; these are exploded, joined with the node table, ordered and concatenated. What lies above is looked up once for each
block and handed down, so the upper nodes, which all leaves need, are never the hot key of a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, table

#: Nodes of a run that become one node, and levels of a tier: a block has RUN ** LEVELS nodes at most.
RUN, LEVELS, TAMPER_EVERY = 2, 6, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "array<struct<left: binary, right: binary>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return hashed(*map(field, values))


def digits(c: Column) -> Column:
    """Lower-case hexadecimal text of bytes; that of joined digests is their joined texts."""
    return F.lower(F.hex(c))


def numbered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with part and place: the number of its range partition and its place there, all ranges in the order of by.

    The result is written: partitions are as Spark cut them once.
    """
    spot = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("spot", F.monotonically_increasing_id())
    return materialize(spot.withColumn("part", F.shiftright("spot", 33)).withColumn("place", F.col("spot").bitwiseAND((1 << 33) - 1)).drop("spot"), "numbered")


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with g, i and n; groups): the group's number, the index in it and its size. leaves: (grp, key ..., leaf ...)."""
    rows = numbered(leaves, ["grp", *(c for c in leaves.columns if c.startswith("key"))])
    parts = rows.groupBy("part", "grp").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    groups = numbered(parts.groupBy("grp").agg(F.sum("here").alias("n")), ["grp"])
    ends = groups.groupBy("part").agg(F.count("*").alias("here")).withColumnRenamed("part", "p")
    ends = ends.select("p", (F.sum("here").over(Window.orderBy("p")) - F.col("here")).alias("before"))  # a row for each range of groups
    groups = groups.join(ends, F.col("part") == F.col("p")).select(F.col("grp").alias("name"), "n", (F.col("before") + F.col("place")).alias("g"))
    start = (F.sum("here").over(Window.partitionBy("grp").orderBy("part")) - F.col("here")).alias("start")  # a row for each range
    parts = parts.select("part", "grp", "first", start).join(groups, F.col("grp").eqNullSafe(F.col("name"))).select(F.col("part").alias("p"), "name", "first", "start", "n", "g")
    out = rows.join(parts, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("name")))
    return out.withColumn("i", F.col("start") + F.col("place") - F.col("first")).drop("part", "place", "p", "name", "first", "start"), groups


def _levels(n: Column, run: int, most: int) -> Column:
    """Levels above n nodes until one is left, but no more than most."""
    out = F.lit(0)
    for k in range(most):
        out = out + F.when(n > run**k, 1).otherwise(0)
    return out


def _up(n: Column, run: int, levels: Column | int) -> Column:
    """Nodes some levels above n nodes."""
    size = F.pow(F.lit(float(run)), levels).cast("long")
    return F.floor((n - 1) / size).cast("long") + 1


def grow(nodes: DataFrame, run: int = RUN, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(tiers, roots): for each tier the node table (g, level, i, n, digest), levels counted from its foot, and (g, root).

    nodes: (g, i, n, digest) with i from 0 to n - 1 in each group g, n the group's size and digest 32 bytes.
    """
    tiers, roots, now, block = [], [], nodes, run**levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        inside = now.groupBy("g", F.floor(F.col("i") / block).alias("b")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("foot"))
        foot = F.array(F.transform("foot", lambda x: digits(x.digest)))

        def fold(all_levels: Column, _: Column) -> Column:
            top = F.element_at(all_levels, -1)
            runs = F.sequence(F.lit(0), F.floor((F.size(top) - 1) / run).cast("int"))
            return F.concat(all_levels, F.array(F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(top, j * run + 1, run), ""), 256))))

        steps = _levels(F.col("n"), run, levels)
        grown = inside.select("g", "b", "n", F.when(steps == 0, foot).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), foot, fold)).alias("all"))
        each = grown.select("g", "b", "n", F.posexplode("all").alias("level", "row")).select("g", "b", "n", "level", F.posexplode("row").alias("at", "digest"))
        at = F.col("b") * F.pow(F.lit(float(run)), levels - F.col("level")).cast("long") + F.col("at")
        tier = materialize(each.select("g", "level", at.alias("i"), _up(F.col("n"), run, F.col("level")).alias("n"), F.unhex("digest").alias("digest")), "nodes")
        tiers.append(tier)
        roots.append(tier.filter("n = 1 and i = 0").select("g", F.col("digest").alias("root")))
        if most <= block:
            break
        most = -(-most // block)
        now = tier.filter((F.col("level") == levels) & (F.col("n") > 1)).select("g", "i", "n", "digest")
    whole = roots[0]
    for r in roots[1:]:
        whole = whole.union(r)
    return tiers, whole


def siblings(asking: DataFrame, tier: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """(g, i, n, path) for each (g, i, n) of a tier's foot: for each level of the tier the siblings before and after it, joined.

    The coordinates follow from i and n alone; a coordinate is asked for by at most a block's nodes.
    """
    steps = _levels(F.col("n"), run, levels)

    def at(level: Column) -> Column:
        size = F.pow(F.lit(float(run)), level).cast("long")
        own, last = F.floor(F.col("i") / size).cast("long"), F.floor((F.col("n") - 1) / size).cast("long")
        first = own - own % run
        others = F.filter(F.sequence(first, F.least(first + run - 1, last)), lambda s: s != own)
        return F.transform(others, lambda s: F.struct(level.alias("level"), s.alias("s"), (s < own).alias("before")))

    asked = F.when(steps > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), at)))
    sought = asking.select("g", "i", "n", F.explode_outer(asked).alias("x")).select("g", "i", "n", "x.*")
    table_of = tier.select(F.col("g").alias("tg"), F.col("level").alias("tl"), F.col("i").alias("ti"), "digest")
    met = sought.join(table_of, (F.col("g") == F.col("tg")) & (F.col("level") == F.col("tl")) & (F.col("s") == F.col("ti")), "left")
    found = met.groupBy("g", "i", "n").agg(F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "s", "before", "digest")))).alias("all"))

    def side(level: Column, before: bool) -> Column:
        own = F.filter("all", lambda x: (x.level == level) & (x.before == before))
        return F.aggregate(own, F.lit(b""), lambda a, x: F.concat(a, x.digest))

    path = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right")))
    return found.select("g", "i", "n", F.when(steps > 0, path).otherwise(F.array().cast(NODE)).alias("path"))


def paths(nodes: DataFrame, tiers: list[DataFrame], above: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """(g, i, path, and the columns of above) for each node: siblings from the foot of the first tier to the group's root.

    above: (g, path, ...) for each group; what it holds is handed down from the tier where the group ends.
    """
    block, extra = run**levels, [c for c in above.columns if c not in ("g", "path")]
    handed = None
    for k in range(len(tiers) - 1, -1, -1):
        asking = nodes.select("g", "i", "n") if k == 0 else tiers[k - 1].filter((F.col("level") == levels) & (F.col("n") > 1)).select("g", "i", "n")
        own = siblings(asking, tiers[k], run, levels).withColumn("b", F.floor(F.col("i") / block))
        ends = above.select("g", F.lit(0).cast("long").alias("b"), F.col("path").alias("upper"), *extra)
        over = ends.join(tiers[k].filter("n = 1 and i = 0").select("g"), "g")
        if handed is not None:
            over = over.union(handed.select("g", F.col("i").alias("b"), F.col("path").alias("upper"), *extra))
        handed = own.join(over, ["g", "b"]).select("g", "i", F.concat("path", "upper").alias("path"), *extra)
        if k:
            handed = materialize(handed, "handed")
    return handed


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal text) and its siblings give."""
    return F.aggregate(path, start, lambda a, x: F.sha2(F.concat(digits(x.left), a, digits(x.right)), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.aggregate(path, F.lit(""), lambda a, x: F.concat(a, digits(x.left), digits(x.right))), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", id_col: str = "doc_id", offered: Callable[[DataFrame], Sequence[Column]] | None = None, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, path, offered) for each row: its leaf, its group's root, the root of all, its siblings
    level by level from the leaf to the root (joined digests before and after it), and the leaf of the offered fields.

    A group's leaves ascend by id, nulls first; rows that share an id ascend by leaf, and equal rows each are a leaf. Groups
    ascend bytewise, null first. Every run of nodes becomes one, the last run too, even of one node; one node alone is the
    root. Null fields and empty ones differ; texts of any length are hashed whole. offered gives the fields' values as they
    are shown for checking; without it they are the rows' own. Other columns are ignored; an empty table gives an empty
    result.
    """
    own = leaf_hash([docs[f] for f in fields])
    shown = leaf_hash(offered(docs)) if offered else own
    leaves = docs.select(
        docs[group].alias("grp"), docs[id_col].alias("key_id"), F.unhex(own).alias("key_leaf"), F.monotonically_increasing_id().alias("key_spot"), F.unhex(shown).alias("offered")
    )
    leaves = materialize(leaves.withColumn("offered", F.when(F.col("offered") != F.col("key_leaf"), F.col("offered"))), "leaves")
    rows, groups = placed(leaves)
    rows = materialize(rows.select("g", "i", "n", "key_id", "key_leaf", "offered"), "placed")
    drop_table(leaves)
    tiers, subroots = grow(rows.select("g", "i", "n", F.col("key_leaf").alias("digest")), run, levels)
    subroots = materialize(subroots, "subroots")
    n_groups = F.lit(groups.count()).cast("long")
    heads = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), n_groups.alias("n"), F.col("root").alias("digest"))
    heads = materialize(heads, "heads")
    top, root = grow(heads, run, levels)
    above = paths(heads, top, root.select("g", F.array().cast(NODE).alias("path"), F.col("root").alias("whole")), run, levels)
    above = materialize(above.select(F.col("i").alias("g"), "path", "whole").join(subroots, "g").withColumnRenamed("root", "subroot"), "above")
    proofs = paths(rows, tiers, above, run, levels)
    out = rows.join(proofs, ["g", "i"])
    return out.select(F.col("key_id").alias(id_col), digits(F.col("key_leaf")).alias("leaf"), digits(F.col("subroot")).alias("subroot"), digits(F.col("whole")).alias("root"), "path", digits(F.coalesce("offered", "key_leaf")).alias("offered"))


def checked(proofs: DataFrame) -> DataFrame:
    """manifest's rows with proof_sha256, folded_root (of the offered leaf and the siblings) and verified."""
    out = proofs.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded(F.col("offered"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents. Where 7 divides the crc32 of doc_id, n_chars is shown as one more, and null stays null.

    A null doc_id is never tampered with; nulls, repeated rows, empty and long texts and empty tables are as in manifest.
    """

    def shown(docs: DataFrame) -> list[Column]:
        tampered = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
        return [docs[f] + F.when(tampered, 1).otherwise(0) if f == "n_chars" else docs[f] for f in FIELDS]

    return checked(manifest(table(spark, sf_dir, "documents"), offered=shown)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({' || '.join(map(_FIELD.format, FIELDS))}) AS leaf,
    sha256({' || '.join(_FIELD.format(f) for f in FIELDS[:3])} || {_FIELD.format("(n_chars + 1)")} || {_FIELD.format("text")}) AS changed,
    4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))) AS crc
  FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g, count(*) OVER () AS g_count FROM (SELECT DISTINCT lang FROM documents)),
placed AS (
  SELECT l.doc_id, l.leaf, l.changed, l.crc, g.g, g.g_count, row_number() OVER (PARTITION BY g.g ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS i, count(*) OVER (PARTITION BY g.g) AS n
  FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang),
nodes AS (
  SELECT g, 0 AS level, i, n, leaf AS digest FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 2),
subroots AS (SELECT g, level AS depth, digest AS subroot FROM nodes WHERE n = 1),
heads AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM langs) AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM heads WHERE n > 1 GROUP BY level, i // 2),
whole AS (SELECT level AS height, digest AS root FROM heads WHERE n = 1),
path AS (
  SELECT p.g, p.i, l.level, (p.i >> l.level) & 1 AS is_right, coalesce(s.digest, '') AS sibling
  FROM placed p JOIN subroots r USING (g), LATERAL (SELECT unnest(range(CAST(r.depth AS BIGINT))) AS level) l
  LEFT JOIN nodes s ON s.g = p.g AND s.level = l.level AND s.i = xor(p.i >> l.level, 1)
  UNION ALL
  SELECT p.g, p.i, r.depth + l.level, (p.g >> l.level) & 1, coalesce(s.digest, '')
  FROM placed p JOIN subroots r USING (g) CROSS JOIN whole w, LATERAL (SELECT unnest(range(CAST(w.height AS BIGINT))) AS level) l
  LEFT JOIN heads s ON s.level = l.level AND s.i = xor(p.g >> l.level, 1)),
proofs AS (SELECT g, i, list(is_right ORDER BY level) AS sides, list(sibling ORDER BY level) AS sibs FROM path GROUP BY g, i),
folded AS (
  SELECT p.*, r.subroot, w.root, coalesce(q.sibs, []) AS sibs,
    list_reduce(list_prepend(CASE WHEN p.crc % 7 = 0 AND p.changed IS NOT NULL THEN p.changed ELSE p.leaf END, coalesce(list_transform(list_zip(q.sides, q.sibs), lambda z: CAST(z[1] AS VARCHAR) || z[2]), [])),
      lambda a, z: CASE WHEN z[1] = '1' THEN sha256(z[2:] || a) ELSE sha256(a || z[2:]) END) AS folded_root
  FROM placed p JOIN subroots r USING (g) CROSS JOIN whole w LEFT JOIN proofs q ON q.g = p.g AND q.i = p.i)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(sibs, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
}
