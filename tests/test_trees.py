"""Tree walks, subtrees and depths against plain versions."""

import random

import pytest

from passagework.operators import tree


def forest(seed, n=120):
    rng = random.Random(seed)
    return [(i, None if i % 40 == 0 else rng.randrange(max(0, i - 15) // 40 * 40, i) if i % 40 else None) for i in range(n)] + [(500, 499), (None, 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long")


def above(rows, i):
    up, out = dict(rows), []
    while up.get(i) in up:
        i = up[i]
        out.append(i)
    return out


@pytest.mark.parametrize("rows", [forest(1), forest(2), [(i, i - 1 if i else None) for i in range(200)], [(7, None)], []])
def test_doubling(spark, rows):
    nodes, ids = frame(spark, rows), [i for i, _ in rows if i is not None]
    rows = [r for r in rows if r[0] is not None]
    assert {r.id: r.depth for r in tree.depths(nodes).collect()} == {i: len(above(rows, i)) for i in ids}
    assert {r.id: r.path for r in tree.paths(nodes).collect()} == {i: "/".join(map(str, [*above(rows, i)[::-1], i])) for i in ids}
    want = {i: [1, 0] for i in ids}
    for i in ids:
        for d, a in enumerate(above(rows, i), 1):
            want[a] = [want[a][0] + 1, max(want[a][1], d)]
    assert {r.id: [r.size, r.height] for r in tree.subtrees(nodes).collect()} == want
    marked = nodes.filter("id % 7 = 3").select("id")
    near = {i: next(((a, d) for d, a in enumerate(above(rows, i), 1) if a % 7 == 3), None) for i in ids}
    assert {r.id: (r.ancestor, r.depth) for r in tree.nearest_above(nodes, marked).collect()} == {i: x for i, x in near.items() if x}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        tree.subtrees(frame(spark, [(1, 2), (2, 1)]))


def plain_walk(rows, roots, most):
    kids: dict = {}
    for i, p in rows:
        if i is not None and p is not None:
            kids.setdefault(p, []).append(i)
    seen: dict = {}

    def walk(i, path, depth):
        if i in seen or depth > most:
            return
        seen[i] = path
        for c in sorted(kids.get(i, [])):
            walk(c, [*path, c], depth + 1)

    for place, r in enumerate(roots):
        walk(r, [place], 0)
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walks_and_first_reach(spark, seed):
    rng, rows = random.Random(seed), forest(seed)
    lists = {q: [rng.randrange(120) for _ in range(6)] for q in (1, 2)}
    lists[3] = [*lists[1], 0]  # a root above others comes last
    roots = spark.createDataFrame([(q, r, k) for q, x in lists.items() for k, r in enumerate(x)], "q int, id long, place int")
    walks = tree.walked(frame(spark, rows), roots, "q", 3)
    want = {q: plain_walk(rows, x, 3) for q, x in lists.items()}
    assert {(r.q, r.id): r.path for r in walks.collect()} == {(q, i): p for q, w in want.items() for i, p in w.items()}
    members = [(i, m) for i in range(120) for m in {rng.randrange(60) for _ in range(2)}]
    got = tree.first_reach(walks, spark.createDataFrame(members, "id long, member int"), "q", 17).collect()
    for q, w in want.items():
        order, taken, groups = sorted(w, key=lambda i: w[i]), set(), []
        for i in order:
            own = sorted({m for j, m in members if j == i} - taken)
            taken |= set(own)
            if own:
                groups.append((len(w[i]) == 1, i, own))
        groups.sort(key=lambda g: (-g[0], -len(g[2])))
        flat = [(i, m) for _, i, own in groups for m in own][:17]
        mine = [(r.id, r.member) for r in sorted((r for r in got if r.q == q), key=lambda r: (r.place, r.member))]
        assert mine == flat
