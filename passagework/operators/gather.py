"""Evidence for many queries at once: sentences are scored where they lie, and only a query's first ones are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import kept

CELLS = 1_000_000
SMALL = 100_000  # rows of an answer that joins may broadcast


class _Block:
    """A block of queries: their words, and for each word the queries that ask for it."""

    def __init__(self, asked: list[list[str]]):
        self.n = len(asked)
        pairs = sorted({(w, i) for i, ts in enumerate(asked) for w in ts})
        names = sorted({w for w, _ in pairs})
        at = {w: k for k, w in enumerate(names)}
        self.words = pa.array(names, pa.string())
        self.queries = np.array([i for _, i in pairs], np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount([at[w] for w, _ in pairs], minlength=len(names)))])
        self.most = max(map(len, asked))

    def scores(self, batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, matrix of sentences by queries): how many of a query's words a sentence has. So many rows come
        first, then twice as many each time, up to CELLS cells or as many hits."""
        ts = batch.column("ts")
        word = pc.index_in(ts.flatten(), value_set=self.words)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        word = pc.fill_null(word, -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        row, word = row[word >= 0], word[word >= 0]
        n = self.first[word + 1] - self.first[word]
        hits = np.concatenate([[0], np.cumsum(n)])
        starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        low = 0
        while low < batch.num_rows:
            high = min(batch.num_rows, low + rows)
            fits = int(np.searchsorted(hits[starts], hits[starts[low]] + 4 * CELLS, "right")) - 1
            high = max(low + 1, min(high, fits))
            a, b = starts[low], starts[high]
            within = np.arange(hits[b] - hits[a]) - np.repeat(hits[a:b] - hits[a], n[a:b])
            q = self.queries[np.repeat(self.first[word[a:b]], n[a:b]) + within]
            cell = np.repeat(row[a:b] - low, n[a:b]) * self.n + q
            yield low, np.bincount(cell, minlength=(high - low) * self.n).reshape(high - low, self.n)
            low, rows = high, min(2 * rows, max(1, CELLS // self.n))


_LEADER = pa.schema([("i", pa.int32()), ("score", pa.int64()), ("source", pa.int64()), ("place", pa.int64()), ("length", pa.int64()), ("key", pa.string())])
_ORDER = ["i", "score", "source", "place"]


def _first_of_each(rows: pd.DataFrame, step: int) -> pd.DataFrame:
    """The first row of each text, and of these a query's first step."""
    rows = rows.sort_values(_ORDER, ascending=[True, False, True, True])
    return rows.drop_duplicates(["i", "key", "length"]).groupby("i").head(step)


def _leaders(block: _Block, left: np.ndarray, taken: set, full: set, step: int):
    """A task's first rows of each query that its choice so far allows, copies of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = pd.DataFrame({n: pd.Series(dtype="object" if n == "key" else "int64") for n in _LEADER.names})
        least, until = np.ones(block.n, np.int64), np.full(block.n, np.iinfo(np.int64).max)
        rows = 256
        for batch in batches:
            source, place, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "place", "length"))
            for low, found in block.scores(batch, rows):
                part = slice(low, low + len(found))
                may = (found > least) | (found == least) & (source[part, None] <= until)
                at, i = np.nonzero(may & (found > 0) & (length[part, None] <= left))
                if not len(at):
                    continue
                key = batch.column("key").take(pa.array(at + low)).to_pylist()
                new = pd.DataFrame({"i": i, "score": found[at, i], "source": source[at + low], "place": place[at + low], "length": length[at + low], "key": key})
                free = [(q, k) not in taken and (q, s) not in full for q, k, s in zip(i.tolist(), key, new["source"].tolist(), strict=True)]
                best = _first_of_each(pd.concat([best, new[free]]), step)
                size = best.groupby("i").size()
                last = best[best["i"].isin(size[size >= step].index)].groupby("i").tail(1)
                least[last["i"].to_numpy(int)], until[last["i"].to_numpy(int)] = last["score"].to_numpy(int), last["source"].to_numpy(int)
            rows = max(1, CELLS // block.n)
        if len(best):
            yield pa.RecordBatch.from_pandas(best, _LEADER, preserve_index=False)

    return run


def _greedy(left: np.ndarray, used: dict, per_source: int, step: int):
    """The choice from the tasks' first rows of one query, up to the first text whose source is full."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        mine, rest, seen, keep = {}, int(left[rows["i"].iloc[0]]), set(), []
        for r in _first_of_each(rows, step).itertuples(index=False):
            if r.key in seen or r.length > rest:
                continue
            had = mine.get(r.source, used.get((r.i, r.source), 0))
            if had >= per_source:
                break
            mine[r.source] = had + 1
            seen.add(r.key)
            rest -= r.length
            keep.append(r)
        return pd.DataFrame(keep, columns=rows.columns)

    return choose


def _before(block: _Block, chosen: pd.DataFrame):
    """How many of a task's rows come before each chosen one, which is given by its number in the table."""
    is_asked = np.zeros((block.n, block.most + 1), bool)
    is_asked[chosen["i"], chosen["score"]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_score, ties = np.zeros((block.n, block.most + 2), np.int64), np.zeros(len(chosen), np.int64)
        every = np.arange(block.n)
        for batch in batches:
            source, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "place"))
            for low, found in block.scores(batch, 4096):
                cells = (every * (block.most + 2) + found).ravel()
                by_score += np.bincount(cells, minlength=by_score.size).reshape(by_score.shape)
                at, i = np.nonzero(is_asked[every, found] & (found > 0))
                both = pd.DataFrame({"i": np.concatenate([i, chosen["i"]]), "score": np.concatenate([found[at, i], chosen["score"]]), "source": np.concatenate([source[at + low], chosen["source"]]), "place": np.concatenate([place[at + low], chosen["place"]]), "own": np.concatenate([np.full(len(at), -1), np.arange(len(chosen))])})
                # a chosen row stands before its equal from the table, so that it does not count itself
                both = both.sort_values([*_ORDER, "own"], ascending=[True, True, True, True, False])
                both["n"] = (both["own"] < 0).groupby([both["i"], both["score"]]).cumsum()
                mine = both[both["own"] >= 0]
                ties[mine["own"].to_numpy(int)] += mine["n"].to_numpy(int)
        above = np.cumsum(by_score[:, ::-1], axis=1)[:, ::-1]
        n = above[chosen["i"], chosen["score"] + 1] + ties
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["own", "n"])

    return run


def evidence(queries: DataFrame, sentences: DataFrame, by: str, source: str, place: str, budget: int, per_source: int, step: int = 96, block_words: int = 20_000) -> DataFrame:
    """(by, source, place, score, length, key, rank): the same choice as verify.evidence() makes of all sentences that share
    a word with a query, score being the number of shared words.

    queries have by and ts (words), sentences have ts, length, key and the integers source and place; those without a
    source are left out, and so are queries without a word. Queries go in blocks of about so many words. In each round a
    task scores its sentences against a block and passes on a query's first step texts; the greedy choice goes on until a
    source is full, since a copy of the next text might then count. The rows of a block that are taken (at most budget
    characters a query) come to the driver and go out with the next round. Ranks are sums of the tasks' counts.
    """
    spark = queries.sparkSession
    q = kept(queries.select(by, F.array_distinct("ts").alias("ts")).filter(F.size("ts") > 0), "asked")
    s = kept(sentences.filter(F.col(source).isNotNull()).select(F.col(source).cast("long").alias("source"), F.col(place).cast("long").alias("place"), F.col("length").cast("long").alias("length"), "key", F.array_distinct("ts").alias("ts")), "sentences")
    n_blocks = -(-(q.agg(F.sum(F.size("ts"))).first()[0] or 0) // block_words)
    out = []
    for b in range(n_blocks):
        rows = q.filter(F.pmod(F.xxhash64(by, "ts"), F.lit(n_blocks)) == b).collect()
        if not rows:
            continue
        block, taken = _Block([r["ts"] for r in rows]), []
        left, open_ones = np.full(len(rows), budget, np.int64), True
        while open_ones:
            keys = {(r["i"], r["key"]) for r in taken}
            count = pd.Series([(r["i"], r["source"]) for r in taken], dtype=object).value_counts()
            used = {k: int(n) for k, n in count.items()}
            full = {k for k, n in used.items() if n >= per_source}
            leaders = s.mapInArrow(_leaders(block, left, keys, full, step), "i int, score long, source long, place long, length long, key string")
            new = leaders.groupBy("i").applyInPandas(_greedy(left, used, per_source, step), leaders.schema).collect()
            for r in new:
                left[r["i"]] -= r["length"]
            taken += new
            open_ones = bool(new)
        if taken:
            chosen = pd.DataFrame(taken, columns=_LEADER.names)
            n = dict(s.mapInArrow(_before(block, chosen), "own int, n long").groupBy("own").agg(F.sum("n")).collect())
            out += [(rows[r["i"]][by], r["source"], r["place"], r["score"], r["length"], r["key"], n[own] + 1) for own, r in enumerate(taken)]
    long = [StructField(c, LongType()) for c in (source, place, "score", "length")]
    kind = StructType([q.schema[by], *long, sentences.schema["key"], StructField("rank", LongType())])
    types = {source: sentences.schema[source].dataType, place: sentences.schema[place].dataType, "rank": IntegerType()}
    found = spark.createDataFrame(out, kind).withColumns({c: F.col(c).cast(x) for c, x in types.items()})
    return F.broadcast(found) if len(out) <= SMALL else found
