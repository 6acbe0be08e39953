"""Operator 5: removal of byte strings that occur more than once, by blockwise suffix sorting with difference covers.

A suffix matters only up to 400 bytes. Every window of 400 bytes has an anchor, the place in it whose next GRAM bytes
hash lowest; equal windows have equal anchors at equal distances. Suffixes that share anchor hash and distance form a
bucket, and only buckets with suffixes of several places need sorting. Neighbouring suffixes of one anchor travel
together as one slice of bytes; slices that are equal as a whole are settled by counting, so a large group of copies
costs one row for each task that meets it.

The slices that are left are sorted block by block in the tasks. In a block, the suffixes at the places of a difference
cover modulo PERIOD get ranks by doubling: by their first PERIOD bytes, then by pairs of ranks, until a rank stands for
DEPTH bytes. Two suffixes of a bucket are compared by at most PERIOD bytes at either end and one look at the ranks at
the distance where both meet the cover, however long their common prefix is. Anchors with more slices than a block holds
are left out of this: their windows are rows with a digest, which are counted; memory is bounded by the block.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, release_shuffles, table
from .ngramjoin import _mix
from .pretokens import slice_hashes, text_runs

LEAST, GRAM, PERIOD, LONGEST = 400, 128, 57, 512
BLOCK_BYTES = 1 << 19  # sorting takes some hundred bytes for each of them
#: Slices of one anchor from which its windows are counted by digest instead of sorted in one block.
MOST_SLICES = 512
#: Bytes of slices that go to a task together.
TASK_BYTES = 8 << 20


@cache
def cover(period: int = PERIOD) -> np.ndarray:
    """A difference cover: places such that every difference modulo period is one of two of them. Found greedily."""
    chosen, missing = [0, 1], set(range(2, period - 1))
    while missing:
        gain = lambda x: len({(x - c) % period for c in chosen} & missing) + len({(c - x) % period for c in chosen} & missing)
        best = max((x for x in range(period) if x not in chosen), key=gain)
        missing -= {(best - c) % period for c in chosen} | {(c - best) % period for c in chosen}
        chosen.append(best)
    return np.array(sorted(chosen))


@cache
def meetings(period: int = PERIOD) -> np.ndarray:
    """For residues i and j the distance to where both meet the cover."""
    there = np.zeros(period, bool)
    there[cover(period)] = True
    both = np.array([np.roll(there, -i)[None, :] & np.array([np.roll(there, -j) for j in range(period)]) for i in range(period)])
    return both.argmax(2)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(h)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    cells = padded.reshape(rows, width)
    left = np.minimum.accumulate(cells, axis=1).ravel()
    right = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(texts: list[bytes], least: int = LEAST, gram: int = GRAM, longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, periodic) of runs of windows that share an anchor hash, in all texts.

    Only in a periodic run, whose anchor hash comes again after its first anchor, can windows equal each other.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    at = np.arange(len(data) - gram + 1)
    h = slice_hashes(data, at, at + gram)
    low = _window_min(h, least - gram + 1)
    left = np.concatenate([[0], np.cumsum(h[: len(low)] == low)])  # anchors that windows have begun at
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(low)]
    place = np.arange(len(low)) - begin[owner]
    whole = place + least <= lengths[owner]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)[run]
    new |= (np.arange(len(low)) - first) % longest == 0  # periodic texts keep one anchor for long
    start = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new), len(low))
    last = stop[np.searchsorted(stop, start, side="right")] - 1
    last = np.minimum(last, begin[owner[start]] + lengths[owner[start]] - least)
    return owner[start], place[start], last - begin[owner[start]], low[start], left[last] > left[start]


def repeats(buckets: np.ndarray, slices: list[bytes], least: int = LEAST, period: int = PERIOD, gram: int = GRAM) -> list[np.ndarray]:
    """For each slice, which of its windows of least bytes equals one of another slice (or another of its own).

    Slices share a bucket number if their anchors do; windows are compared with those of the bucket at the same distance
    to their anchor. The comparison is exact.
    """
    lengths = np.array([len(s) for s in slices], np.int64)
    begin = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(slices), np.uint8)
    n_windows = lengths - least + 1
    window = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + np.repeat(begin, n_windows)
    owner = np.repeat(np.arange(len(slices)), n_windows)
    # ranks of the cover's suffixes, by doubling; a rank stands for depth bytes
    depth = period * ((least - period) // period)
    d = cover(period)
    is_cover = np.zeros(period, bool)
    is_cover[d] = True
    slice_of = np.repeat(np.arange(len(slices)), lengths)
    left = (begin + lengths)[slice_of] - np.arange(len(data))
    sample = np.flatnonzero(is_cover[np.arange(len(data)) % period] & (left >= period))
    width = -(-period // 8) * 8
    rows = np.zeros((len(sample), width), np.uint8)
    for k in range(period):
        rows[:, k] = data[sample + k]
    rank = np.full(len(data) + 1, -1, np.int64)
    rank[sample] = np.unique(rows.view(f"V{width}").ravel(), return_inverse=True)[1]
    have, steps = period, depth // period
    by_depth = {1: rank}
    while have < depth:
        one, more = have // period, min(have, depth - have) // period
        if more not in by_depth:
            more = 1 << (more.bit_length() - 1)
        a, b = by_depth[one], by_depth[more]
        ok = sample[left[sample] >= have + more * period]
        key = a[ok] * (len(data) + 1) + b[ok + have]
        grown = np.full(len(data) + 1, -1, np.int64)
        grown[ok] = np.unique(key, return_inverse=True)[1]
        have += more * period
        by_depth[have // period] = grown
    rank = by_depth[steps]
    meet = meetings(period)
    # a bucket: anchor and distance to it
    h = slice_hashes(data, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    low = _window_min(h, least - gram + 1)[window]
    at = np.flatnonzero(np.isin(h, np.unique(low)))
    reach = at[np.searchsorted(at, window)]
    while True:  # the first place from the window's start on whose hash is the window's least
        off = h[reach] != low
        if not off.any():
            break
        reach[off] = at[np.searchsorted(at, reach[off] + 1)]
    key = buckets[owner].astype(np.uint64) ^ _mix((reach - window).astype(np.uint64) + np.uint64(1))
    head = np.zeros(len(window), np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | data[window + k]
    order = np.lexsort((head, key))
    repeated = np.zeros(len(window), bool)
    group = np.append(True, (key[order][1:] != key[order][:-1]) | (head[order][1:] != head[order][:-1]))
    todo, tie = window[order], np.cumsum(group) - 1
    index = order
    while len(todo):  # compare each tie's suffixes with its first; those that differ go on among themselves
        lead = np.flatnonzero(np.append(True, tie[1:] != tie[:-1]))
        size = np.diff(np.append(lead, len(tie)))
        keep = np.repeat(size > 1, size)
        todo, tie, index = todo[keep], tie[keep], index[keep]
        if not len(todo):
            break
        lead = np.flatnonzero(np.append(True, tie[1:] != tie[:-1]))
        size = np.diff(np.append(lead, len(tie)))
        first = np.repeat(lead, size)
        a, b = todo, todo[first]
        far = meet[a % period, b % period]
        same = rank[a + far] == rank[b + far]
        check = np.flatnonzero(same & (a != b))
        for k in (*range(period), *range(depth, least)):  # bytes before and after what the rank covers
            if not len(check):
                break
            bad = data[a[check] + k] != data[b[check] + k]
            same[check[bad]] = False
            check = check[~bad]
        equal = np.add.reduceat(same.astype(np.int64), lead)
        repeated[index[same & (np.repeat(equal, size) > 1)]] = True
        todo, tie, index = todo[~same], tie[~same], index[~same]
    cuts = np.cumsum(n_windows)[:-1]
    return np.split(repeated, cuts)


SPAN = "key binary, begin long, stop long"


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of [begin, stop) rows as maximal runs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]])


def row_key() -> Column:
    """What tells a row (doc_id, text) from others: 128 bits of a digest of both. Rows that share it are alike in both."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))


def repeated_spans(docs: DataFrame, least: int = LEAST, most_slices: int = MOST_SLICES) -> DataFrame:
    """(key, begin, stop): byte ranges of runs of windows that occur elsewhere, as a table; ranges may overlap and repeat.

    docs: (key, text). Rows that share a key must share the text; each counts as an occurrence of it.
    """
    spark = docs.sparkSession

    def find(batches):
        for batch in batches:
            for first_row, own in text_runs(batch.column(1)):
                text, first, last, low, periodic = anchors(own, least)
                if len(text):
                    digest = [hashlib.blake2b(own[t][a : b + least], digest_size=16).digest() for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
                    keys = batch.column(0).take(pa.array(first_row + text))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(low.view(np.int64)), pa.array(digest, pa.binary()), pa.array(periodic)], names=["key", "first", "last", "anchor", "digest", "periodic"])

    runs = materialize(docs.mapInArrow(find, "key binary, first long, last long, anchor long, digest binary, periodic boolean"), "anchors")
    slices = runs.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.max("periodic").alias("periodic"), F.min(F.struct("key", "first", "last")).alias("one"))
    busy = slices.groupBy("anchor").agg(F.count("*").alias("slices"), F.sum("n").alias("runs"), F.max("periodic").alias("any")).filter("runs > 1 or any")
    kinds = materialize(slices.join(busy, "anchor").select("anchor", "digest", "n", "slices", "periodic", "one"), "slices")
    release_shuffles(spark)
    settled = runs.join(kinds.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("key", F.col("first").alias("begin"), (F.col("last") + least).alias("stop"))
    # slices that several runs have are known to repeat; they stay as company for the others of their anchor
    open_ones = kinds.filter("slices > 1 or periodic").select("anchor", (F.col("slices") > most_slices).alias("many"), (F.col("n") > 1).alias("known"), "one.*")
    to_sort = open_ones.filter("not many").agg(F.sum(F.col("last") - F.col("first") + least)).first()[0] or 0
    wanted = open_ones.filter("not many").groupBy("key").agg(F.collect_list(F.struct("anchor", "known", "first", "last")).alias("runs"))
    held = wanted.join(docs, "key").select("key", "text", "runs")

    def cut(batches):
        for batch in batches:
            for at, texts in text_runs(batch.column(1), rows=200):
                out = []
                for key, data, own in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, batch.column(2).slice(at, len(texts)).to_pylist(), strict=True):
                    out += [(r["anchor"], r["known"], key, r["first"], data[r["first"] : r["last"] + least]) for r in own]
                for some in range(0, len(out), 10_000):
                    columns = zip(*out[some : some + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, KINDS, strict=True)], names=NAMES)

    dealt = held.mapInArrow(cut, "anchor long, known boolean, key binary, first long, slice binary").repartition(max(1, to_sort // TASK_BYTES), "anchor").sortWithinPartitions("anchor")

    def sort(batches):
        held_rows, size = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(at, 2048)])
                held_rows = part if held_rows is None else pa.concat_tables([held_rows, part])
                size += part.nbytes
                if size > BLOCK_BYTES:
                    keys = held_rows.column("anchor").to_numpy()
                    cut_at = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
                    if cut_at:
                        yield from sorted_block(held_rows.slice(0, cut_at))
                        held_rows = held_rows.slice(cut_at).combine_chunks()
                        size = held_rows.nbytes
        if held_rows is not None and held_rows.num_rows:
            yield from sorted_block(held_rows)

    def sorted_block(t: pa.Table):
        keys, known = t.column("anchor").to_numpy(), t.column("known").to_pylist()
        found = repeats(keys, t.column("slice").to_pylist(), least)
        out = []
        for key, first, k, hit in zip(t.column("key").to_pylist(), t.column("first").to_pylist(), known, found, strict=True):
            if not k and hit.any():
                edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                out += [(key, first + int(a), first + int(b) - 1 + least) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "begin", "stop"])

    def digests(batches):
        for batch in batches:
            for row, texts in text_runs(batch.column(1), rows=200):
                for key, data, own in zip(batch.column(0).slice(row, len(texts)).to_pylist(), texts, batch.column(2).slice(row, len(texts)).to_pylist(), strict=True):
                    for r in own:
                        at = range(r["first"], r["last"] + 1)
                        found = [hashlib.blake2b(data[a : a + least], digest_size=16).digest() for a in at]
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array([r["anchor"]] * n, pa.int64()), pa.array([1 + r["known"]] * n, pa.int32()), pa.array([key] * n, pa.binary()), pa.array(at, pa.int64()), pa.array(found, pa.binary())], names=["anchor", "weight", "key", "begin", "digest"])

    partly = materialize(dealt.mapInArrow(sort, SPAN), "spans")
    release_shuffles(spark)
    crowded = open_ones.filter("many").groupBy("key").agg(F.collect_list(F.struct("anchor", "known", "first", "last")).alias("runs"))
    windows = materialize(crowded.join(docs, "key").select("key", "text", "runs").mapInArrow(digests, "anchor long, weight int, key binary, begin long, digest binary"), "windows")
    twice = windows.groupBy("anchor", "digest").agg(F.sum("weight").alias("n")).filter("n > 1").select("anchor", "digest")
    counted = windows.filter("weight = 1").join(twice, ["anchor", "digest"], "left_semi").select("key", "begin", (F.col("begin") + least).alias("stop"))
    all_spans = materialize(settled.union(partly).union(counted), "spans")
    for t in (runs, kinds, partly, windows):
        drop_table(t)
    release_shuffles(spark)
    return all_spans


NAMES = ["anchor", "known", "key", "first", "slice"]
KINDS = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()]


def without_repeats(docs: DataFrame, least: int = LEAST, most_slices: int = MOST_SLICES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: kept has the bytes that no repeated window covers.

    Null and empty texts have no bytes; texts shorter than a window lose nothing. Every row is judged by itself, also
    those without doc_id or with one that others have; rows alike in both columns are copies of each other. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", row_key())
    spans = repeated_spans(rows.filter(F.octet_length("text") >= least).select("key", "text"), least, most_slices)
    per_row = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))

    def remove(batches):
        for batch in batches:
            for at, texts in text_runs(batch.column(1)):
                out = []
                for doc_id, data, own in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, batch.column(2).slice(at, len(texts)).to_pylist(), strict=True):
                    kept = data
                    ranges = merged(np.array([(s["begin"], s["stop"]) for s in own or []], np.int64).reshape(-1, 2)).tolist()
                    if ranges:
                        places = [0, *(x for r in ranges for x in r), len(data)]
                        kept = b"".join([data[a:b] for a, b in zip(places[::2], places[1::2], strict=True)])
                    out.append((doc_id, len(data), sum(b - a for a, b in ranges), len(ranges), kept))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.binary()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(per_row, "key", "left").select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    more = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("has_repeats")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)
