"""Raw binary matrices as a Spark data source: fixed-width records, read by byte ranges and written with a commit.

A record is a row's key, a little-endian 64-bit integer, and dim components of one type. spark.read.format("raw_matrix")
cuts every file on record bounds, so a file of any size is read by many tasks; a task holds a batch of records at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id long, v array<float>"
RANGE_BYTES, BATCH = 64 << 20, 4096


def record(dim: int, dtype: str) -> np.dtype:
    return np.dtype([("id", "<i8"), ("v", np.dtype(dtype).newbyteorder("<"), (dim,))])


@dataclass
class Range(InputPartition):
    """Records of one file, by bytes."""

    path: str
    start: int
    length: int


@dataclass
class Written(WriterCommitMessage):
    """A task's file, under the name it has until the commit; none if it had no rows."""

    path: str | None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kind = options, record(int(options["dim"]), options.get("dtype", "float32"))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        size, out = self.kind.itemsize, []
        step = max(1, int(self.options.get("range_bytes", RANGE_BYTES)) // size) * size
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        for info in sorted(found, key=lambda f: f.path):
            if info.type != fs.FileType.File or not info.base_name.endswith(".bin"):
                continue
            if info.size % size:
                raise ValueError(f"{info.path} has {info.size} bytes, which is no multiple of a record's {size}")
            out += [Range(info.path, at, min(step, info.size - at)) for at in range(0, info.size, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        with store.open_input_file(partition.path) as f:
            for at in range(0, partition.length, BATCH * self.kind.itemsize):
                n = min(BATCH * self.kind.itemsize, partition.length - at)
                rows = np.frombuffer(f.read_at(n, partition.start + at), self.kind)
                flat = pa.array(np.ascontiguousarray(rows["v"], np.float32).ravel())
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows["v"].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["id"])), pa.ListArray.from_arrays(ends, flat)], names=["id", "v"])


class Writer(DataSourceArrowWriter):
    """Each task writes a file of its own; the commit gives the files of the tasks that count their final names."""

    def __init__(self, options: dict):
        self.options, self.kind, self.name = options, record(int(options["dim"]), options.get("dtype", "float32")), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        path, out = f"{root}/_{uuid.uuid4().hex}.open", None
        try:
            for batch in batches:
                if batch.column(0).null_count or batch.column(1).null_count:
                    raise ValueError("a record has no place for a null")
                v = batch.column(1)
                dim = self.kind["v"].shape[0]
                if not np.all(v.value_lengths().to_numpy(zero_copy_only=False) == dim):
                    raise ValueError(f"a vector has not {dim} components")
                rows = np.zeros(batch.num_rows, self.kind)
                rows["id"] = batch.column(0).to_numpy()
                rows["v"] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if out is None:
                    store.create_dir(root)
                    out = store.open_output_stream(path)
                out.write(rows.tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(path if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        store.create_dir(root)
        for k, m in enumerate(messages):
            if m is not None and m.path:
                store.move(m.path, f"{root}/{self.name}-{k:05d}.bin")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


class RawMatrix(DataSource):
    """Options: path (a folder of the file store, which driver and executors share), dim, dtype, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "raw_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawMatrix)
