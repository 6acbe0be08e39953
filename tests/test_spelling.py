"""Near names of all lengths and spelling suggestions against plain loops; whole lines of pages; whole queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import joins
from passagework.plans import search_queries


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def edited(rng, name, edits):
    for _ in range(edits):
        i = rng.randrange(len(name) + 1)
        name = rng.choice([name[:i] + rng.choice("abcd") + name[i:], name[:i] + name[i + 1 :], name[:i] + rng.choice("abcd") + name[i + 1 :]]) or "a"
    return name


@pytest.mark.parametrize("most", [1, 2])
def test_names_on_both_sides_of_the_border(spark, most):
    """Lengths around LONG, where deletions give way to pieces, very long names, empty ones, repeated ones and nulls."""
    rng = random.Random(most)
    whole = ["".join(rng.choice("abcd") for _ in range(n)) for n in [1, 2, 3, *range(joins.LONG - 3, joins.LONG + 5), 300] for _ in range(6)]
    near = [edited(rng, w, rng.randint(0, 3)) for w in whole for _ in range(4)]
    a = spark.createDataFrame([(w,) for w in [*whole, whole[0], "", None]], "a string")
    b = spark.createDataFrame([(w,) for w in [*near, "", None]], "b string")
    got = sorted(tuple(r) for r in joins.fuzzy(a, b, F.col("a"), F.col("b"), most, [F.col("a"), F.col("b")]).collect())
    pairs = {(x, y) for x in [*whole, ""] for y in [*near, ""] if abs(len(x) - len(y)) <= most}
    assert got == sorted((x, y, d) for x, y in pairs if (d := distance(x, y)) <= most)
    assert any(len(x) == 300 for x, _, _ in got)


def test_suggestions_equal_a_plain_loop(spark):
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("ehtab") for _ in range(rng.randint(2, 17))) for _ in range(250)})
    asked = sorted({edited(rng, w, rng.randint(0, 3)) for w in known})
    total = {w: 1 + i % 9 for i, w in enumerate(known)}
    q, v = spark.createDataFrame([(w,) for w in asked], "w string"), spark.createDataFrame(list(total.items()), "s string, n long")
    got = {(r.w, r.s): (r.distance, r.sub, r.score) for r in joins.suggestions(q, v, "w", "s", "n", alike="the").collect()}

    def within(x, y):
        rest = iter(y)
        return all(c in rest for c in x)

    want = {}
    for x in asked:
        for y in known:
            if len(x) >= 3 and len(y) >= 3 and x != y and abs(len(x) - len(y)) <= 2:
                d = min(distance(x, y), distance(x[:-1], y[:-1]) if x[-1] in "the" and y[-1] in "the" else 99)
                if d <= (2 if len(x) >= 7 else 1):
                    sub = within(x, y) or within(y, x)
                    want[x, y] = (d, sub, 10 * d - 4 * sub - 2 * (x[0] == y[0]) - 0.6 * math.log2(1 + total[y]))
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-5 for k in want)


def test_lines_hold_their_whole_text(spark):
    html = '<h1 id="a">One <em>two</em></h1><p><b>bold</b> and<br>more<p class="x">next <a href="/u">link</a> end</p><pre>no</pre><p></p>'
    rows = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(F.transform(T.lines(F.col("h")), T.line_text).alias("l")).collect()
    assert [r.l for r in rows] == [["One two", "bold and more", "next link end", ""], [], None]


def test_keyword_baseline_reads_whole_queries(spark):
    docs = [(1, "a red fox jumps over it"), (2, "fox red jumps a over"), (3, "a red fox"), (4, None), (5, "a a a a"), (6, "")]
    asked = [(1, "A red fox jumps"), (2, "a"), (3, "unheard word a"), (4, None)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string"), "benchmark": spark.createDataFrame(asked, "item_id long, text string")}
    got = sorted(tuple(r) for r in search_queries.keyword_baseline(tables.get).collect())
    assert got == [(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True), (2, 3, True), (2, 5, True)]
