"""Files in the shared folder that Python tasks write and read themselves."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs:, or a plain local path) and the path in it."""
    if "://" not in uri:
        return fs.LocalFileSystem(), unquote(urlparse(uri).path) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def attempt_name(suffix: str) -> tuple[int, str]:
    """The partition's number, and a file name that no other attempt at it uses."""
    from pyspark import TaskContext

    task = TaskContext.get()
    n = task.partitionId() if task else 0
    return n, f"part-{n:06d}-{task.taskAttemptId() if task else 0}{suffix}"
