"""Ranks by ranges, resampling sums, and the raw matrix source."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import evaluation, ranks
from passagework.operators.shared import new_path
from passagework.sources import matrices


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group, a group of one, a null group, ties and null values."""
    data = [("hot", i, i % 7) for i in range(700)] + [("one", 1, 3), (None, 5, 1), (None, 6, None), (None, 7, 1)]
    return spark.createDataFrame(data, "g string, k int, v int").repartition(9), data


def test_before_and_slots(spark, rows):
    df, data = rows
    got = {(r.g, r.k): (r.before, r.total) for r in ranks.before(df, ["g"], ["k"]).collect()}
    slots = {(r.g, r.k): r.slot for r in ranks.slots(df, ["g"], ["k"], 3).collect()}
    for g in {x[0] for x in data}:
        own = sorted(k for a, k, _ in data if a == g)
        cuts = [len(own) // 3 + (i < len(own) % 3) for i in range(3)]
        want = [i + 1 for i, n in enumerate(cuts) for _ in range(n)]
        for i, k in enumerate(own):
            assert got[g, k] == (i, len(own)) and slots[g, k] == want[i]
    assert ranks.before(df.limit(0), ["g"], ["k"]).count() == 0
    spread = ranks.before(df.repartition(4), ["g"], ["k"], falling=True)
    assert {(r.g, r.k): r.before for r in spread.filter("g = 'hot'").collect()} == {("hot", k): 699 - k for k in range(700)}


def test_ranks_and_percentiles(spark, rows):
    df, data = rows
    for r in ranks.ranked(df, ["g"], "v").collect():
        own = [v for g, _, v in data if g == r.g]
        greater = sum(1 for v in own if v is not None and (r.v is None or v > r.v))
        assert (r["rank"], r.n, r.total) == (1 + greater, own.count(r.v), len(own))
    got = {r.g: r.p50 for r in evaluation.floor_percentile(df.filter("v is not null"), ["g"], "v", 0.5).collect()}
    for g in {x[0] for x in data}:
        own = sorted(v for a, _, v in data if a == g and v is not None)
        assert got[g] == own[len(own) // 2]


@pytest.mark.parametrize("rounds", [1, 4, 10])
def test_resampling(spark, rounds):
    values = [(i, float(i % 5)) for i in range(60)]
    got = {r["round"]: r["mean"] for r in evaluation.bootstrap(spark.createDataFrame(values, "k int, x double"), "k", "x", rounds).collect()}
    for n in range(1, rounds + 1):
        weights = []
        for k, _ in values:
            d = hashlib.md5(f"{k}:{(n - 1) // 4}".encode()).hexdigest()[8 * ((n - 1) % 4) :][:8]
            weights.append(sum(int(d, 16) / 2**32 >= edge for edge in evaluation.POISSON))
        assert got[n] == pytest.approx(sum(w * x for w, (_, x) in zip(weights, values, strict=True)) / sum(weights), abs=1e-6)
    assert len(got) == rounds


@pytest.mark.parametrize("dtype", ["int8", "float32"])
def test_raw_matrix(spark, dtype):
    matrices.register(spark)
    m = np.random.default_rng(1).integers(-100, 100, (5000, 6))
    where = {"path": new_path(spark, "raw"), "dim": "6", "dtype": dtype}
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m.tolist())], matrices.SCHEMA).repartition(3).write.format("raw_matrix").options(**where).mode("append").save()
    back = spark.read.format("raw_matrix").options(range_bytes="1000", **where).load()
    assert back.rdd.getNumPartitions() > 10
    assert {r.id: r.v for r in back.collect()} == {i: v for i, v in enumerate(m.tolist())}
    assert back.select(F.sum("id")).first()[0] == sum(range(5000))
    empty = {**where, "path": new_path(spark, "raw")}
    spark.createDataFrame([], matrices.SCHEMA).write.format("raw_matrix").options(**empty).mode("append").save()
    assert spark.read.format("raw_matrix").options(**empty).load().count() == 0
    with pytest.raises(Exception, match="components"):
        spark.createDataFrame([(1, [1.0])], matrices.SCHEMA).write.format("raw_matrix").options(**where).mode("append").save()
    assert spark.read.format("raw_matrix").options(**where).load().count() == 5000  # a failed job leaves nothing to be read
    with pytest.raises(Exception, match="multiple"):
        spark.read.format("raw_matrix").options(**{**where, "dim": "7"}).load().count()
