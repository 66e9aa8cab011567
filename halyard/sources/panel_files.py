"""A data source for panels of many units: one scan over all their Parquet files, whatever each file's columns are.

    spark.dataSource.register(PanelFiles)
    spark.read.format("halyard_panels").load(root)

`root` has a folder for each unit, with files in its folder `panels`, or else in itself. The driver only lists them; files go
to tasks in runs of so many bytes, and each task reads the footer of a file, picks its columns and reads those alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from halyard.sources.files import listed, open_fs, packed

SCHEMA = "unit_id string, panel string, asset string, date date, value double, tie bigint, file string, problem string"
TYPES = [pa.string(), pa.string(), pa.string(), pa.date32(), pa.float64(), pa.int64(), pa.string(), pa.string()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def unit_files(root: str, units: set[str] | None = None) -> Iterator[tuple[int, tuple[str, str, str]]]:
    """(bytes, (unit, panel, path)) of every panel file of the units (None: all)."""
    fs, base = open_fs(root)
    files = [f for f in listed(fs, base, deep=True) if f.path.endswith(".parquet") and f.is_file]
    found: dict[str, dict[bool, list]] = {}
    for f in files:
        parts = PurePosixPath(f.path).relative_to(base).parts
        if len(parts) == 2 or (len(parts) == 3 and parts[1] == "panels"):
            found.setdefault(parts[0], {}).setdefault(len(parts) == 3, []).append(f)
    for unit, by_depth in sorted(found.items()):
        if units is None or unit in units:
            for f in by_depth.get(True) or by_depth[False]:
                yield f.size, (unit, PurePosixPath(f.path).stem, f.path)


def _days(col: pa.ChunkedArray) -> pa.Array:
    """Dates, times or their ISO texts as days; what is none is null."""
    if pa.types.is_date(col.type) or pa.types.is_timestamp(col.type):
        return col.cast(pa.timestamp("us")).cast(pa.date32(), safe=False).combine_chunks()
    text = pd.Series(pc.utf8_slice_codeunits(col.cast(pa.string()), 0, 10).to_pandas(), dtype=object)
    day = pd.to_datetime(text, format="%Y-%m-%d", errors="coerce")
    return pa.array(day.dt.date, pa.date32(), from_pandas=True)


def read_panel(path: str, root: str, unit: str, panel: str) -> Iterator[pa.RecordBatch]:
    """The rows of one file; none if it lacks date, value or an asset's column. A file that can't be read gives one row with its problem."""
    try:
        with open_fs(root)[0].open_input_file(path) as f:
            file = pq.ParquetFile(f)
            asset = next((c for c in ("asset", "asset_id") if c in file.schema_arrow.names), None)
            if asset is None or not {"date", "value"} <= set(file.schema_arrow.names):
                return
            seen = 0
            for b in file.iter_batches(65536, columns=["date", asset, "value"]):
                t = pa.Table.from_batches([b])
                n = t.num_rows
                one = [pa.array([x] * n, pa.string()) for x in (unit, panel)]
                cols = [*one, t.column(asset).cast(pa.string()).combine_chunks(), _days(t.column("date")), t.column("value").cast(pa.float64(), safe=False).combine_chunks()]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(seen, seen + n), pa.int64()), pa.array([path] * n, pa.string()), pa.nulls(n, pa.string())], names=NAMES)
                seen += n
    except (OSError, ValueError, pa.ArrowException) as e:
        row = [unit, panel, None, None, None, None, path, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], names=NAMES)


class Run(InputPartition):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class PanelReader(DataSourceReader):
    def __init__(self, root: str, most_bytes: int, most_files: int, units: set[str] | None):
        self.root, self.most_bytes, self.most_files, self.units = root, most_bytes, most_files, units

    def partitions(self) -> Sequence[InputPartition]:
        files = list(unit_files(self.root, self.units))
        return [Run(r) for r in packed(files, self.most_bytes, self.most_files)] or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        for unit, panel, path in partition.files:
            yield from read_panel(path, self.root, unit, panel)


class PanelFiles(DataSource):
    """Options: path, mostBytes (of a task's files, 64 MB), mostFiles (256), units (JSON list: only these are listed)."""

    @classmethod
    def name(cls) -> str:
        return "halyard_panels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PanelReader:
        return PanelReader(self.options["path"], int(self.options.get("mostBytes", 64 << 20)), int(self.options.get("mostFiles", 256)), set(json.loads(self.options["units"])) if "units" in self.options else None)
