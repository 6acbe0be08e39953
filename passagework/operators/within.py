"""Runs of words inside texts, for as many runs as there are texts: a filter of bounded size lets only words' places through
that may begin a run, so neither all words nor all pairs of equal beginnings are shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Bits of the filter for each run, and in all at most; words of a text that one step takes at most, unless it is longer.
BITS, MOST_BITS, STEP = 32, 1 << 30, 500_000
#: Odd factors of two polynomials over 64-bit numbers, with their inverses.
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: Longer runs are looked up by so many of their first words: the greatest of these numbers that they have.
HEADS = (*range(3, 11), 16, 32, 64, 128, 256)


class _Sums:
    """A step's texts of words parted by one blank: numbers of any run of words, from prefix sums of two polynomials over
    128-bit digests of the words."""

    def __init__(self, texts: pa.Array):
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        self.starts = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        digests = b"".join(blake2b(w.encode(), digest_size=16).digest() for w in coded.dictionary.to_pylist())
        own = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        code = coded.indices.to_numpy()
        self.sums, self.back = [], []
        for k, (base, inverse) in enumerate(_BASES):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code), base)]))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(own[code, k] * power[:-1])]))
            self.back.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code), inverse)])))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.starts))

    def places(self, n: int) -> np.ndarray:
        """Where a run of so many words can begin."""
        at = np.arange(max(0, len(self.row) - n + 1))
        return at[self.row[at] == self.row[at + n - 1]]

    def number(self, at: np.ndarray, n: np.ndarray | int, k: int) -> np.ndarray:
        return (self.sums[k][at + n] - self.sums[k][at]) * self.back[k][at]


def _steps(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, _Sums]]:
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy() // 4 + 1)])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, size[low] + STEP, "right")) - 1)
        part = batch.slice(low, high - low)
        yield part, _Sums(part.column(column))
        low = high


def numbered(runs: DataFrame, text: str) -> DataFrame:
    """runs (key, text, cuts) with a row for each of the cuts (array of (at, n) in words): key, at, n, h1, h2."""
    key = next(c for c in runs.columns if c not in (text, "cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sums in _steps(batch, 1):
                cuts = part.column(2)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(cuts).to_numpy())
                at, n = (cuts.flatten().field(f).to_numpy() for f in ("at", "n"))
                h = [sums.number(sums.starts[row] + at, n, k).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at), pa.array(n), *map(pa.array, h)], names=[key, "at", "n", "h1", "h2"])

    return runs.select(key, text, "cuts").mapInArrow(run, f"`{key}` {runs.schema[key].dataType.simpleString()}, at long, n long, h1 long, h2 long")


def _filter(runs: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """A bit for each of the runs' two numbers, and the numbers of words they have. Its size follows the number of runs up
    to MOST_BITS; more runs let more through, which the join then drops."""
    n, lengths = runs.agg(F.count("*"), F.collect_set("n")).first()
    size = min(MOST_BITS, max(1 << 16, 1 << (n * BITS - 1).bit_length())) if n else 1 << 16
    shift, page = 64 - size.bit_length() + 1, 1 << 16
    spot = lambda c: F.shiftrightunsigned(c, shift)

    def fold(t: pa.Table) -> pa.Table:
        bits = np.zeros(page, np.uint8)
        bits[t.column("spot").to_numpy() % page] = 1
        return pa.table({"page": t.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    spots = runs.select(F.explode(F.array(spot("h1"), spot("h2"))).alias("spot")).distinct().withColumn("page", F.floor(F.col("spot") / page))
    out = np.zeros(size // 8, np.uint8)
    for r in spots.groupBy("page").applyInArrow(fold, "page long, bits binary").toLocalIterator():
        out[r["page"] * (page // 8) : (r["page"] + 1) * (page // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out, shift, sorted(lengths)


def met(runs: DataFrame, docs: DataFrame, doc_key: str, text: str) -> DataFrame:
    """(doc_key, n, h1, h2) of all places of texts where a run (n, h1, h2) may stand, and few others: an equal join tells.
    A text's words are parted by one blank; a null one has none."""
    bits, shift, lengths = _filter(runs)
    held, by = docs.sparkSession.sparkContext.broadcast(bits), np.uint64(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = held.value
        known = lambda h: (there[(spot := h >> by) >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
        for batch in batches:
            for part, sums in _steps(batch, 1):
                for n in lengths:
                    at = sums.places(n)
                    at = at[known(sums.number(at, n, 0))]
                    at = at[known(sums.number(at, n, 1))]
                    h = [pa.array(sums.number(at, n, k).view(np.int64)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(sums.row[at])), pa.array(np.full(len(at), n, np.int64)), *h], names=[doc_key, "n", "h1", "h2"])

    return docs.select(doc_key, text).mapInArrow(run, f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, n long, h1 long, h2 long")


def holders(runs: DataFrame, docs: DataFrame, run: str, doc_key: str, text: str) -> DataFrame:
    """(run, doc_key), each once: the texts that have a run of three words or more, word by word. Runs and texts are words
    parted by one blank; equal runs are looked up once. What the first words of a run find is compared as a whole."""
    size = F.size(F.split(run, " ")).cast("long")
    head = F.array_max(F.filter(F.array(*[F.lit(h).cast("long") for h in HEADS]), lambda h: h <= size))
    asked = runs.select(run).distinct().filter(size >= HEADS[0])
    cuts = asked.select(run, F.col(run).alias("_text"), F.array(F.struct(F.lit(0).cast("long").alias("at"), head.alias("n"))).alias("cuts"))
    named = kept(numbered(cuts, "_text").select(run, "n", "h1", "h2"), "runs")
    found = met(named, docs, doc_key, text).distinct().join(named, ["n", "h1", "h2"]).select(run, doc_key)
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return found.join(docs.select(doc_key, F.col(text).alias("_text")), doc_key).filter(F.contains(padded("_text"), padded(run))).select(run, doc_key).distinct()
