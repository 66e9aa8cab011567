"""A data source that writes a file for each unit, and reads back what was committed.

    spark.dataSource.register(UnitFiles)
    df.write.format("halyard_unit_files").option("file", "forecast.parquet").mode("overwrite").save(path)

A task attempt writes into a folder of its own name. Only when all tasks have ended does the driver write the manifest, which
lists the folders of the attempts that count, and put it in place of the last one in one step. So readers see all of a write
or nothing of it: attempts that failed, ran twice or lost their executor leave files that no manifest lists, and abort()
removes those it hears of. `file` ends in .parquet (columns of the rows but unit_id) or else holds the text of column value.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from halyard.sources.files import as_folder, listed, open_fs, packed, unit_of


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    units: int
    rows: int


def manifest_path(base: str, file: str) -> str:
    return f"{base}/_manifests/{file}.json"


def manifest(path: str, file: str) -> list[str]:
    """Folders of the committed attempts, in order; none if nothing was committed."""
    fs, base = open_fs(path)
    at = manifest_path(base, file)
    if fs.get_file_info(at).type != pafs.FileType.File:
        return []
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())["attempts"]


class UnitFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file: str, overwrite: bool):
        self.path, self.file, self.overwrite = path, file, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, base = open_fs(self.path)
        folder = f"attempt-{uuid.uuid4().hex}"
        seen: list[str] = []
        rows, put, close = 0, None, []
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                ids = table.column("unit_id").to_pylist()
                rest = table.drop_columns(["unit_id"])
                cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    part = rest.slice(a, b - a)
                    if not seen or ids[a] != seen[-1]:
                        for c in reversed(close):
                            c()
                        put, close = self._begin(fs, f"{base}/{folder}", ids[a], part.schema)
                        seen.append(ids[a])
                    put(part)
                    rows += b - a
        finally:
            for c in reversed(close):
                c()
        return Attempt(folder, len(seen), rows)

    def _begin(self, fs: pafs.FileSystem, folder: str, unit: str | None, schema: pa.Schema) -> tuple[Callable[[pa.Table], None], list[Callable[[], None]]]:
        """(what writes rows of a unit to its file, what closes it)."""
        if unit is None:
            raise ValueError("a row without unit_id")
        at = f"{folder}/{as_folder(unit)}"
        fs.create_dir(at, recursive=True)
        if fs.get_file_info(f"{at}/{self.file}").type != pafs.FileType.NotFound:
            raise ValueError(f"rows of {unit} are not together")
        stream = fs.open_output_stream(f"{at}/{self.file}", compression=None)
        if self.file.endswith(".parquet"):
            out = pq.ParquetWriter(stream, schema)
            return out.write_table, [stream.close, out.close]
        return lambda part: stream.write("".join((v or "") for v in part.column("value").to_pylist()).encode()) and None, [stream.close]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_fs(self.path)
        old = [] if self.overwrite else manifest(self.path, self.file)
        new = [m.folder for m in messages if m is not None and m.rows]
        fs.create_dir(f"{base}/_manifests", recursive=True)
        aside = f"{manifest_path(base, self.file)}.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside, compression=None) as f:
            f.write(json.dumps({"file": self.file, "attempts": old + new}).encode())
        fs.move(aside, manifest_path(base, self.file))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_dir_contents(f"{base}/{m.folder}", missing_dir_ok=True)


class Run(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class UnitFileReader(DataSourceReader):
    def __init__(self, path: str, file: str, schema: StructType):
        self.path, self.file, self.kind = path, file, schema

    def partitions(self) -> Sequence[InputPartition]:
        """Of a unit that several attempts hold, the last committed file."""
        fs, base = open_fs(self.path)
        last: dict[str, tuple[int, str]] = {}
        for folder in manifest(self.path, self.file):
            for f in listed(fs, f"{base}/{folder}", deep=True):
                if f.is_file and PurePosixPath(f.path).name == self.file:
                    last[PurePosixPath(f.path).parent.name] = (f.size, f.path)
        files = [(n, (unit_of(u), p)) for u, (n, p) in sorted(last.items())]
        return [Run(r) for r in packed(files, 64 << 20, 512)] or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        fs, kind = open_fs(self.path)[0], to_arrow_schema(self.kind)
        rest = [f for f in kind if f.name != "unit_id"]
        for unit, path in partition.files:
            with fs.open_input_file(path) as f:
                if self.file.endswith(".parquet"):
                    tables = (pa.Table.from_batches([b]) for b in pq.ParquetFile(f).iter_batches(columns=[c.name for c in rest]))
                else:
                    tables = iter([pa.table({"value": [f.read().decode()]})])
                for t in tables:
                    cols = {c.name: t.column(c.name).cast(c.type) for c in rest} | {"unit_id": pa.array([unit] * t.num_rows, pa.string())}
                    yield from pa.table([cols[c.name] for c in kind], names=kind.names).to_batches()


class UnitFiles(DataSource):
    """Options: path, file (the name of each unit's file)."""

    @classmethod
    def name(cls) -> str:
        return "halyard_unit_files"

    def schema(self) -> str:
        if self.options["file"].endswith(".parquet"):
            raise ValueError("give the schema of the Parquet files")
        return "unit_id string, value string"

    def reader(self, schema: StructType) -> UnitFileReader:
        return UnitFileReader(self.options["path"], self.options["file"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> UnitFileWriter:
        return UnitFileWriter(self.options["path"], self.options["file"], overwrite)


def write_unit_files(rows: DataFrame, path: str, file: str, order: tuple[str, ...] = (), mode: str = "overwrite", placed: bool = False) -> None:
    """One file for each unit_id, its rows ordered by `order`, all of them or none. placed: each unit's rows are together and in order."""
    rows.sparkSession.dataSource.register(UnitFiles)
    if not placed:
        rows = rows.repartition("unit_id").sortWithinPartitions("unit_id", *order)
    rows.write.format("halyard_unit_files").option("file", file).mode(mode).save(path)


def read_unit_files(spark: SparkSession, path: str, file: str, schema: str = "unit_id string, value string") -> DataFrame:
    spark.dataSource.register(UnitFiles)
    return spark.read.format("halyard_unit_files").schema(schema).option("file", file).load(path)
