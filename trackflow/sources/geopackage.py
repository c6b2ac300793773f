"""GeoPackage reader: every feature layer of every file in a folder as rows.

The files must lie where every executor can open them (a shared mount). One
task reads a share of one file's row ids, so a large file is split. A schema that names fewer columns reads
fewer. Filters are Spark's: a reader that keeps pushed filters applies them to later queries of the same DataFrame, too.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The attribute names in the files and the column each becomes.
FIELDS = {
    "ID": ("id", "int"),
    "Rasse": ("breed_label", "string"),
    "Time": ("time_text", "string"),
    "Day": ("day", "int"),
    "Hour": ("hour", "int"),
    "TimeSlice": ("time_slice", "string"),
    "Altitude": ("altitude", "double"),
    "PDOP": ("pdop", "double"),
    "Valid": ("valid", "string"),
    "NSat": ("nsat", "int"),
}
SCHEMA = (
    "source_file string, source_layer string, fid long, "
    + ", ".join(f"{name} {kind}" for name, kind in FIELDS.values())
    + ", x double, y double"
)
# Columns that a layer's own table holds, by their names here.
COLUMNS = {"fid": "rowid", **{name: field for field, (name, _) in FIELDS.items()}}
# Bytes of the optional envelope by its code in the geometry header flags.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
BYTES_PER_TASK = 128 << 20
ROWS_PER_BATCH = 10_000


def point(blob: bytes | None) -> tuple[float | None, float | None]:
    """x, y of a GeoPackage point blob; None for no, empty or other geometry."""
    if not blob or blob[:2] != b"GP":
        return None, None
    start = 8 + ENVELOPE_BYTES.get(blob[3] >> 1 & 7, 0)
    order = "<" if blob[start] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", blob, start + 1)
    if kind % 1000 != 1:
        return None, None
    x, y = struct.unpack_from(order + "dd", blob, start + 5)
    return (None, None) if x != x else (x, y)


@dataclass
class FilePart(InputPartition):
    path: str
    part: int
    parts: int
    layer: str | None = None  # all layers


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layers(db: sqlite3.Connection) -> list[str]:
    return [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features'").fetchall()]


def _row_ids(db: sqlite3.Connection, layer: str) -> tuple[int | None, int | None]:
    return db.execute(f"select min(rowid), max(rowid) from {_quoted(layer)}").fetchone()


class GeoPackageReader(DataSourceReader):
    """Reads the columns of ``schema`` only.

    Planning looks at file sizes alone; files are opened, and their layers listed, in the tasks. A large file is
    several tasks, each of which reads its share of every layer's row ids.
    """

    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.folder = options["path"]
        self.bytes_per_task = int(options.get("bytesPerTask", BYTES_PER_TASK))
        self.rows_per_task = int(options.get("rowsPerTask", 0))

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path in sorted(glob.glob(os.path.join(self.folder, "*.gpkg"))):
            if self.rows_per_task:
                found += self._layer_parts(path)
            else:
                parts = max(1, -(-os.path.getsize(path) // self.bytes_per_task))
                found += [FilePart(path, i, parts) for i in range(parts)]
        return found

    def _layer_parts(self, path: str) -> list[InputPartition]:
        """Tasks of about ``rowsPerTask`` rows, if asked for: this opens the file while planning."""
        found: list[InputPartition] = []
        with _open(path) as db:
            for layer in _layers(db):
                lo, hi = _row_ids(db, layer)
                if lo is not None:
                    parts = -(-(hi + 1 - lo) // self.rows_per_task)
                    found += [FilePart(path, i, parts, layer) for i in range(parts)]
        return found

    def statement(self, layer: str, geometry: str, present: set[str]) -> tuple[str, list[str]]:
        """The query of a layer by row id range, and the columns that it gives after the row id."""
        wanted = {f.name for f in self.schema}
        names = ["_geometry"] if wanted & {"x", "y"} else []
        names += [name for name, field in COLUMNS.items() if name in wanted and field in present]
        shown = ["rowid", *[_quoted(geometry if n == "_geometry" else COLUMNS[n]) for n in names if n != "fid"]]
        return f"select {', '.join(shown)} from {_quoted(layer)} where rowid between ? and ? order by rowid", [n for n in names if n != "fid"]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        with _open(partition.path) as db:
            for layer in _layers(db):
                if partition.layer in (None, layer):
                    yield from self._layer(db, partition, layer, arrow)

    def _layer(self, db: sqlite3.Connection, partition: FilePart, layer: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        lo, hi = _row_ids(db, layer)
        if lo is None:
            return
        first = lo + (hi + 1 - lo) * partition.part // partition.parts
        last = lo + (hi + 1 - lo) * (partition.part + 1) // partition.parts - 1
        geometry = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", [layer]).fetchone()[0]
        present = {r[1] for r in db.execute(f"pragma table_info({_quoted(layer)})")}
        query, names = self.statement(layer, geometry, present)
        rows = db.execute(query, [first, last])
        while chunk := rows.fetchmany(ROWS_PER_BATCH):
            found = {
                "source_file": [os.path.basename(partition.path)] * len(chunk),
                "source_layer": [layer] * len(chunk),
                "fid": [r[0] for r in chunk],
            }
            for i, name in enumerate(names, 1):
                if name == "_geometry":
                    points = [point(r[i]) for r in chunk]
                    found["x"], found["y"] = [p[0] for p in points], [p[1] for p in points]
                else:
                    found[name] = [r[i] for r in chunk]
            nothing = [None] * len(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(found.get(f.name, nothing), type=f.type) for f in arrow], schema=arrow)


class GeoPackageSource(DataSource):
    """``spark.read.format("gpkg_tracks").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "gpkg_tracks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(schema, self.options)


def register(spark) -> None:
    """Makes the format known; the reader's code travels with the job."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GeoPackageSource)
