"""Lines of ESRI shapefiles: a data source whose partitions are ranges of the index, with the attributes of the table beside it.

Defined cases: a null shape, and a shape that is neither line nor polygon, gives
no rows; a part of a line is a trace of its own; measures and heights are left
out; a record that does not fit its own counts is an error that names file and
record, or is left out with the option ``skip_bad``.  Without a table, or with a
shorter one, attributes are empty.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, feature int, part int, seq int, x double, y double, attributes map<string, string>"
# Shape types with parts (lines and polygons, plain, with heights, with measures).
WITH_PARTS = {3, 5, 13, 15, 23, 25}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.lower().endswith(".shp"))


def _beside(file: str, ending: str) -> str:
    return file[:-3] + (ending.upper() if file[-3:].isupper() else ending)


class Table:
    """Rows of the attribute table, read by number."""

    def __init__(self, store: fs.FileSystem, file: str):
        name = _beside(file, "dbf")
        self.file = store.open_input_file(name) if store.get_file_info(name).type == fs.FileType.File else None
        self.rows, self.fields = 0, []
        if self.file is None:
            return
        self.rows, self.first, self.size = struct.unpack("<IHH", self.file.read(12)[4:12])
        self.file.seek(32)
        at = 1
        for raw in iter(lambda: self.file.read(32), b""):
            if raw[:1] == b"\r" or len(raw) < 32:
                break
            self.fields.append((raw[:11].split(b"\0")[0].decode("utf-8", "replace"), at, raw[16]))
            at += raw[16]

    def row(self, k: int) -> list[tuple[str, str]]:
        if k >= self.rows:
            return []
        self.file.seek(self.first + k * self.size)
        raw = self.file.read(self.size)
        return [(n, raw[a : a + w].decode("utf-8", "replace").strip(" \0")) for n, a, w in self.fields]


def parts(content: bytes) -> list[np.ndarray]:
    """The parts of a record's content, each (vertices, 2)."""
    if len(content) < 4:
        raise ValueError("too short")
    kind = struct.unpack("<i", content[:4])[0]
    if kind not in WITH_PARTS:
        return []
    if len(content) < 44:
        raise ValueError("too short")
    n, m = struct.unpack("<ii", content[36:44])
    if n < 0 or m < 0 or len(content) < 44 + 4 * n + 16 * m:
        raise ValueError("counts do not fit")
    first = np.frombuffer(content, "<i4", n, 44).astype(np.int64)
    points = np.frombuffer(content, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2)
    ends = np.append(first[1:], m)
    if n and (first[0] != 0 or (ends < first).any() or ends[-1] > m):
        raise ValueError("parts out of order")
    return [points[a:b] for a, b in zip(first, ends, strict=True)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("records", 10_000))
        self.skip = options.get("skip_bad", "false").lower() == "true"

    def partitions(self):
        store, _ = _store(self.path)
        out = []
        for file in _files(self.path):
            n = (store.get_file_info(_beside(file, "shx")).size - 100) // 8
            out += [InputPartition((file, a, min(n, a + self.most))) for a in range(0, n, self.most)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        file, a, b = partition.value
        store, _ = _store(self.path)
        with store.open_input_file(_beside(file, "shx")) as f:
            f.seek(100 + 8 * a)
            index = np.frombuffer(f.read(8 * (b - a)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        table = Table(store, file)
        with store.open_input_file(file) as f:
            for k, (at, size) in enumerate(index.tolist(), a):
                f.seek(at + 8)
                try:
                    content = f.read(size)
                    if len(content) < size:
                        raise ValueError("past the end of the file")
                    found = parts(content)
                except ValueError as e:
                    if self.skip:
                        continue
                    raise ValueError(f"{file}, record {k}: {e}") from e
                if not found:
                    continue
                row = table.row(k)
                for j, p in enumerate(found):
                    n = len(p)
                    same = [pa.array([file] * n, pa.string()), *(pa.array(np.full(n, v, np.int32)) for v in (k, j))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array([row] * n, pa.map_(pa.string(), pa.string()))], names=["file", "feature", "part", "seq", "x", "y", "attributes"])


class ShapeSource(DataSource):
    """Vertices of lines and polygons: path (a file or a folder), records a partition, skip_bad."""

    @classmethod
    def name(cls):
        return "shapes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_shapefile(spark: SparkSession, path: str, records: int = 10_000, skip_bad: bool = False) -> DataFrame:
    """(file, feature, part, trace_id, seq, x, y, class): one trace for each part with two vertices or more; class is the attribute of that name."""
    spark.dataSource.register(ShapeSource)
    p = spark.read.format("shapes").option("records", str(records)).option("skip_bad", str(skip_bad).lower()).load(path)
    last = F.max("seq").over(Window.partitionBy("file", "feature", "part"))
    named = F.concat_ws("/", "file", F.col("feature").cast("string"), F.col("part").cast("string"))
    kept = p.withColumn("_last", last).where("_last > 0")
    return kept.select("file", "feature", "part", named.alias("trace_id"), "seq", "x", "y", F.nullif(F.try_element_at("attributes", F.lit("class")), F.lit("")).alias("class"))
