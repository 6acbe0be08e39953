"""The manifest, hard negatives and posting lists against brute force, on small and odd tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import hardneg, manifest, postings

LEAVES = "doc_id long, source string, lang string, n_chars long, text string, g long, i long, n long, path string, leaf string, grp string, level int"
VECTORS = "vec_id long, embedding array<float>, label int, id long, dim int, v string, block string, asks boolean, far double, cell int, rank int, score double"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def folded_up(nodes, run):
    """All levels above a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        top = levels[-1]
        levels.append([h(*top[at : at + run]) for at in range(0, len(top), run)])
    return levels


def others(levels, at, run):
    """A node's siblings on each level but the last: (before, after)."""
    out = []
    for level in levels[:-1]:
        first = at - at % run
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + run])))
        at //= run
    return out


def plain_manifest(rows, run):
    leaf = {k: h(*map(field, r)) for k, r in enumerate(rows)}
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2], []).append(k)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        order = sorted(groups[g], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        trees[g] = order, folded_up([leaf[k] for k in order], run)
    top = folded_up([trees[g][1][-1][0] for g in names], run)
    out = []
    for j, g in enumerate(names):
        order, levels = trees[g]
        for at, k in enumerate(order):
            path, (i, source, lang, n, text) = others(levels, at, run) + others(top, j, run), rows[k]
            changed = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            now = h(*map(field, (i, source, lang, n + 1, text))) if changed else leaf[k]
            for a, b in path:
                now = h(a, now, b)
            out.append((i, leaf[k], levels[-1][0], top[-1][0], h(*(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def documents(n, langs):
    return [(i, "s" if i % 3 else None, langs[i % len(langs)], None if i % 11 == 0 else i * 7, None if i % 13 == 0 else "é " * (i % 5)) for i in range(n)]


CASES = {
    "none": [],
    "one": [(3, None, None, 1, "")],
    "null id, repeated ids and rows": [(None, "a", "x", 1, "t"), (None, "a", "x", 1, "t"), (7, "a", "x", 2, "u"), (7, "b", "x", None, None), (7, "b", "x", None, None), (8, "", None, 0, "w" * 200_000)],
    "many": documents(301, ["en", "de", None, "zz", "e", "", "Ä"]),
    "a hot group": documents(200, ["en"] * 9 + [None]),
}


@pytest.mark.parametrize("run, levels", [(2, 2), (3, 2), (2, 6)])
@pytest.mark.parametrize("case", CASES)
def test_manifest(spark, case, run, levels):
    if (run, levels) != (2, 2) and case != "many":
        pytest.skip("the other shapes are held on the largest case")
    docs = spark.createDataFrame([(*r, 1, 2, 3, "p", "l", "q", 4) for r in CASES[case]], LEAVES)

    def shown(d):
        tampered = F.coalesce(F.crc32(d["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
        return [d[f] + tampered.cast("int") if f == "n_chars" else d[f] for f in manifest.FIELDS]

    rows = manifest.checked(manifest.manifest(docs.repartition(5), offered=shown, run=run, levels=levels))
    found = rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == plain_manifest(CASES[case], run)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 2, "v", "b", True, 0.5, 3, 4, 0.25) for i, v, k in rows], VECTORS)


def clustered(n, dim, centres, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    m = c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def plain_negatives(rows, positives=5, negatives=10):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), k) for i, v, k in rows if i is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, q, label in (x for x in good if x[0] % 100 == 0):
        scored = sorted((-int(q @ v), i, k) for i, v, k in good if i != a and len(v) == len(q))
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            kept = [(j, -s) for s, j, k in scored if k != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, i, r, j, -p, s) for r, (j, s) in enumerate(kept, 1)]
    return sorted(out)


def odd_vectors():
    base = clustered(900, 12, 6, 3).tolist()
    rows = [(i, v, (i // 3) % 4) for i, v in enumerate(base)]
    rows += [(1000 + i, base[5], i % 3) for i in range(150)]  # one vector many times
    rows += [(1200, None, 1), (1300, [], 1), (1400, [float("nan")] * 12, 1), (1500, [1.0] * 11 + [None], 0), (1600, [0.0] * 12, 1), (1700, base[7], None), (None, base[8], 1), (1801, [0.0] * 12, 2), (1900, [0.5] * 3, 1), (1901, [0.5] * 3, 1), (1902, [0.3] * 3, 2)]
    return rows


@pytest.mark.parametrize("per_block", [65_536, 40])
def test_hard_negatives(spark, per_block):
    rows = odd_vectors()
    found = hardneg.hard_negatives(vectors(spark, rows), F.col("label"), F.col("vec_id") % 100 == 0, per_block=per_block)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)
    twice = hardneg.hard_negatives(vectors(spark, rows + rows[:300]), F.col("label"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, twice.collect())) == plain_negatives(rows)
    assert hardneg.hard_negatives(vectors(spark, []), F.col("label"), F.col("vec_id") % 100 == 0).count() == 0


def test_brackets_never_lose_a_pair():
    m = np.floor(256 * clustered(400, 8, 5, 4).astype(float))
    top = (m**2).sum(1).max()
    extra = np.sqrt(np.maximum(top - (m**2).sum(1), 0))
    space = hardneg.Space(top, hardneg.spread(np.column_stack([m, extra]), 8))
    far, asking = hardneg.distances(m, extra, space.pivots), hardneg.distances(m[:50], np.zeros(50), space.pivots)
    score = m[:50] @ m.T
    low, high = np.full(50, 20_000.0), np.full(50, 50_000.0)
    left = hardneg.survivors(asking, far, space.reach(m[:50], low), space.reach(m[:50], high), space.slack)
    inside = (score >= 20_000) & (score <= 50_000)
    assert left[inside].all() and left.mean() < 0.8  # and some pairs are never multiplied


def plain_nearest(rows, k=10):
    best = {}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a, q in good:
        if a % 100 == 0:
            for i, v in good:
                if i != a and len(v) == len(q):
                    d = float(np.sqrt(((q - v) ** 2).sum()))
                    best[a, i] = min(d, best.get((a, i), np.inf))
    out = {}
    for (a, i), d in best.items():
        out.setdefault(a, []).append((d, i))
    return {a: sorted(x)[:k] for a, x in out.items()}


def test_posting_lists(spark):
    rows = odd_vectors() + odd_vectors()[:50]
    table = vectors(spark, rows)
    plain = plain_nearest([(i, v) for i, v, _ in rows])
    # all lists in reach: nothing is lost, ties included
    found = {}
    for r in postings.nearest(table, F.col("vec_id") % 100 == 0, listed=64, target=1.0, per_block=100).collect():
        found.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id, r["rank"]))
    assert found.keys() == plain.keys()
    hits = sum(len({x[1] for x in found[a]} & {i for _, i in plain[a]}) for a in plain)
    assert hits >= 0.97 * sum(map(len, plain.values()))
    for a in plain:
        got = sorted(found[a], key=lambda x: x[2])
        assert [x[2] for x in got] == list(range(1, len(plain[a]) + 1)) and got == sorted(got)
    assert postings.nearest(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_recall(spark, spread):
    m = clustered(4000, 24, 60, 9, spread)
    rows = [(i, v, 0) for i, v in enumerate(m.tolist())]
    plain = plain_nearest([(i, v) for i, v, _ in rows])
    got = {(r.query_id, r.vec_id) for r in postings.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, listed=64).collect()}
    assert sum((a, i) in got for a, x in plain.items() for _, i in x) >= 0.9 * len(got) and len(got) == 400


def test_lists_are_balanced_and_boundaries_posted_twice():
    m = clustered(4000, 24, 60, 9, 0.3).astype(float)
    graph = postings.Graph(postings.bisected(m, 64, np.random.default_rng(1)))
    lists = graph.lists(m)
    sizes = np.bincount([x for row in lists for x in row], minlength=64)
    assert sizes.max() <= 6 * sizes.mean() and all(1 <= len(x) <= postings.COPIES for x in lists)
    assert sum(len(x) > 1 for x in lists) > 40
    exact = np.sqrt(postings.squares(m, graph.c))
    assert np.mean([row[0] == e for row, e in zip(lists, exact.argmin(1), strict=True)]) > 0.98
    met = graph.search(m[:200], 1.2)
    wanted = exact[:200] <= 1.2 * exact[:200].min(1, keepdims=True)
    assert np.isfinite(met[wanted]).mean() > 0.95
