"""Files that tasks write in the shared folder, through Arrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def create(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file that no other attempt of the task writes. Only paths that a committed manifest lists are read."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)


def reopen(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def spread(manifest: DataFrame) -> DataFrame:
    """One row to a task, or nearly: a manifest is a few small files, which Spark would read as one partition."""
    n = manifest.count()
    return manifest.repartition(max(1, n)) if n > 1 else manifest


def rows_of(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in cols], strict=True)
