"""Operator 3: token ids as binary files of equal-length sequences.

Documents are range-partitioned by doc_id; each task encodes its range, appends the end id to each document and packs
all ids without gaps into sequences of fixed length. A shard is an Arrow stream in the file format whose batches hold
two fixed-size lists a row, ids and mask (the last sequence is padded), so that sequence k of a shard is found from
its number alone and is read without copies from a mapped file. Beside it lies an index of documents (doc_id, first
id in the shard, number of ids). A retried task writes under another name; only files named in the manifest count.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, materialize, new_path, table, worker_cache
from .files import attempt_name, filesystem
from .pretokens import TwoGenerations, pieces, text_runs

LENGTH, ROWS, END = 2048, 256, 0
#: Documents in a batch of the index, and documents that are read back at once.
INDEXED, DOCS = 4096, 4096
#: Bytes of pieces with their ids that a worker keeps, twice at most, and bytes of text that it works on at once.
CACHED, AT_ONCE = 96 << 20, 4 << 20
MANIFEST = "shard int, path string, n_tokens long, n_docs long"


def encoder(path: str):
    """The tokenizer of a file, its cache of pieces, and a pattern of its added tokens, or None."""
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()})
        marks = re.compile(b"|".join(map(re.escape, added))) if added else None
        cache["tokenizer", path] = tokenizer, TwoGenerations(CACHED), marks
    return cache["tokenizer", path]


def token_ids(column: pa.Array, path: str, dtype):
    """For runs of texts: (number of the first, all their ids end to end, number of ids per text).

    The library encodes each distinct piece between the split's boundaries once; merges never cross them. A text that
    holds an added token, such as an end mark, is encoded by the library as a whole.
    """
    tokenizer, known, marks = encoder(path)
    code = np.dtype(dtype).char
    for first, texts in text_runs(column, AT_ONCE, 20_000):
        marked = {k: x for k, x in enumerate(texts) if marks and marks.search(x)}
        distinct, index, per_text = pieces([b"" if k in marked else x for k, x in enumerate(texts)])
        entries = known.many(distinct)
        new = [i for i, e in enumerate(entries) if e is None]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for i, e in zip(part, tokenizer.encode_batch_fast([distinct[i].decode() for i in part], add_special_tokens=False), strict=True):
                entries[i] = known.put(distinct[i], array(code, e.ids).tobytes())
        ids, upto = np.zeros(0, dtype), np.zeros(1, np.int64)
        if len(index):
            _, offsets, values = pa.array(entries, pa.large_binary()).take(pa.array(index)).buffers()
            upto = np.frombuffer(offsets, np.int64, len(index) + 1) // np.dtype(dtype).itemsize
            ids = np.frombuffer(values, dtype, upto[-1])
        ends_of = upto[np.concatenate([[0], np.cumsum(per_text)])]
        counts = np.diff(ends_of)
        if marked:
            parts = np.split(ids, ends_of[1:-1])
            for k, text in marked.items():
                parts[k] = np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        yield first, ids, counts


def write_sequences(docs: DataFrame, out: str, tokenizer_path: str, length: int = LENGTH, end: int = END, vocabulary: int = 50_257) -> DataFrame:
    """Write docs in ascending doc_id order as shards under the folder out; the manifest (shard, path, n_tokens, n_docs).

    Shards are numbered in doc_id order, nulls first; rows that share a doc_id follow by text. Null and empty texts give
    the end id alone. Ids take two bytes where the vocabulary allows, else four. Other columns are ignored. An empty
    table has an empty manifest.
    """
    dtype = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def write(batches):
        n, name = attempt_name(".arrow")
        system, folder = filesystem(out)
        system.create_dir(folder, recursive=True)
        kind = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        total, index, held, size = 0, [], [], 0
        stream = system.open_output_stream(f"{folder}/{name}")
        with stream, pa.ipc.new_file(stream, kind) as writer:

            def flush(last: bool) -> None:
                nonlocal held, size
                data = np.concatenate(held) if held else np.zeros(0, dtype)
                unit = length if last else length * ROWS  # all batches but the last are full
                full = len(data) // unit * unit
                ids, real = data[:full], full
                if last and full < len(data):
                    real = len(data)
                    ids = np.concatenate([data, np.zeros(-len(data) % length, dtype)])
                for a in range(0, len(ids), length * ROWS):
                    part = ids[a : a + length * ROWS]
                    mask = np.arange(a, a + len(part)) < real
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (part, mask)]
                    writer.write_batch(pa.record_batch(lists, schema=kind))
                held, size = ([] if last else [data[full:]]), 0 if last else len(data) - full

            for batch in batches:
                for first, ids, counts in token_ids(batch.column(1), tokenizer_path, dtype):
                    marked = np.insert(ids, np.cumsum(counts), end)
                    held.append(marked)
                    size += len(marked)
                    for key, c in zip(batch.column(0).slice(first, len(counts)).to_pylist(), counts.tolist(), strict=True):
                        index.append((key, total, c + 1))
                        total += c + 1
                    if size >= length * ROWS:
                        flush(False)
            flush(True)
        with system.open_output_stream(f"{folder}/{name}.index") as s:
            cols = list(zip(*index, strict=True)) or [(), (), ()]
            t = pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start", "n_tokens"), cols, strict=True)})
            with pa.ipc.new_file(s, t.schema) as w:
                w.write_table(t, INDEXED)
        if index:
            yield pa.RecordBatch.from_pylist([{"shard": n, "path": f"{out}/{name}", "n_tokens": total, "n_docs": len(index)}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return materialize(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


class Shard:
    """One shard: sequences and documents by number, without copies where the file can be mapped."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        local = system.type_name == "local"
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
        self.index = pa.ipc.open_file(pa.memory_map(path + ".index") if local else system.open_input_file(path + ".index"))
        self.length = self.file.schema.field("ids").type.list_size
        self.last = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = k, self.file.get_batch(k)
        return self.last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence k."""
        b, row = self.batch(k // ROWS), k % ROWS
        ids = b.column(0).values.to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length]
        return ids, b.column(1)[row].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the shard."""
        per, parts = self.length * ROWS, []
        while n > 0:
            k, at = divmod(start, per)
            got = self.batch(k).column(0).values.to_numpy(zero_copy_only=True)[at : at + n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def read_documents(manifest: DataFrame, docs_per_task: int = DOCS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all before it.

    A task reads a stretch of a shard's index and the sequences that it names, so a shard can be read by many tasks.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    stretches = placed.select("path", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_per_task).cast("long"))).alias("at"))

    def read(batches):
        for batch in batches:
            for path, base, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, left = Shard(path), docs_per_task
                for k in range(at // INDEXED, shard.index.num_record_batches):
                    skip = max(0, at - k * INDEXED)
                    docs = shard.index.get_batch(k).slice(skip, left)
                    left -= docs.num_rows
                    crc = [zlib.crc32(shard.ids(s, n).astype("<u4").tobytes()) for s, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)]
                    start = pa.array(docs.column(1).to_numpy(zero_copy_only=False) + base, pa.int64())
                    yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    if not left:
                        break

    return dealt(stretches).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary_path

    docs = table(spark, sf_dir, "documents")
    return read_documents(write_sequences(docs, new_path(spark, "tokens"), vocabulary_path("byte_bpe_50k.json")))
