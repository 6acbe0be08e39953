"""Searches that hold a block of rows in memory and let queries stream past it. Operators 12 and 13 stand on this.

A row is shuffled once, to its block; a query goes to each block that may hold an answer. In a task the rows of a block
come first and then its queries, batch by batch, so memory is bounded by the block, however many queries ask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def vectors_of(t: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    v = t.column(name)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def past_blocks(rows: DataFrame, kind: str, hold: Callable[[pa.Table], object], ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], order: tuple[str, ...] = ("id",)) -> DataFrame:
    """What ask yields for each batch of queries and the block that they ask, as hold has made it of the block's rows.

    rows: (block string, asks boolean, ...), those with asks false being the block's rows, in the given order.
    """

    def run(batches):
        now, parts, held = None, [], None
        for batch in batches:
            names, asks = batch.column("block"), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ends = names.dictionary_encode().indices.to_numpy() * 2 + asks
            cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(ends)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                piece, name = batch.slice(a, b - a), names[a].as_py()
                if name != now:
                    now, parts, held = name, [], None
                if not asks[a]:
                    parts.append(piece)
                    continue
                if parts:
                    held, parts = hold(pa.Table.from_batches(parts)), []
                if held is not None:
                    yield from ask(held, piece)

    return rows.repartition("block").sortWithinPartitions("block", "asks", *order).mapInArrow(run, kind)
