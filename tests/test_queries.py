"""Some queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
import compare

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["token_counts", "bm25_topk", "segment_range_join", "as_of_join", "streaks", "rank_metrics", "nearest_place", "stream_daily", "window_limit_stream", "contained_refused", "multi_field_bm25", "group_assignment"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(compare.norm(r[c]) for c in cols)) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in rel.description]
    other = sorted(repr(tuple(compare.norm(r[heads.index(c)]) for c in cols)) for r in rel.fetchall())
    assert mine == other


def test_entry(spark):
    assert entry.entry(spark).count() > 0
