"""Georeferenced TIFF rasters: a data source that reads blocks (strips or tiles) as Spark partitions, and a writer of tile sets.

``spark.read.format("geotiff")`` lists a file or the files of a folder, reads
their headers, and makes a partition of every run of blocks of about
``block_bytes``.  Bounds on r and c, and an equal grid_id, choose the blocks;
the others are not read.  A grid of any size is written as a folder of tiles,
each a file of its own made by one task.

Read: byte order of either kind, classic and big files, strips and tiles,
bands side by side or apart, no compression or deflate, horizontal and
floating-point predictors, integers and floats.  Anything else is an error that
names the file.  Values equal to nodata become NaN.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cuesta.operators.fixpoint import settled
from cuesta.operators.normalise import gdal_cells
from cuesta.operators.tiles import TILE, spread

SCHEMA = "grid_id string, band int, r int, c int, z double"
# Sizes of a field's types, and the tags that are read.
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, MATRIX, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113


class Header:
    """The first image of a file: its tags, the blocks it is stored in, and where it lies."""

    def __init__(self, file, name: str):
        self.name = name
        head = file.read(16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        version = struct.unpack(self.order + "H", head[2:4])[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError(f"{name}: not a TIFF file")
        self.big = version == 43
        at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
        count, entry = ("Q", 20) if self.big else ("H", 12)
        file.seek(at)
        n = struct.unpack(self.order + count, file.read(struct.calcsize(count)))[0]
        rows = file.read(n * entry)
        self.tags: dict[int, tuple | bytes] = {}
        for row in (rows[i : i + entry] for i in range(0, n * entry, entry)):
            tag, kind = struct.unpack(self.order + "HH", row[:4])
            if kind not in _SIZES:
                continue
            items = struct.unpack(self.order + ("Q" if self.big else "I"), row[4:12] if self.big else row[4:8])[0]
            form = f"{self.order}{items}s" if kind == 2 else self.order + _SIZES[kind] * items
            size, own = struct.calcsize(form), row[12:] if self.big else row[8:]
            if size > len(own):
                file.seek(struct.unpack(self.order + ("Q" if self.big else "I"), own)[0])
                own = file.read(size)
            values = struct.unpack(form, own[:size])
            self.tags[tag] = values[0].rstrip(b"\0") if kind == 2 else values
        self.width, self.height = self._one(WIDTH), self._one(HEIGHT)
        self.samples, self.apart = self._one(SAMPLES, 1), self._one(PLANAR, 1) == 2
        self.compression, self.predictor = self._one(COMPRESSION, 1), self._one(PREDICTOR, 1)
        bits, kind = self._one(BITS, 1), self._one(FORMAT, 1)
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 2, 3) or bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or len({*self.tags[BITS]}) > 1:
            raise ValueError(f"{name}: unsupported compression, predictor or sample")
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
        tiled = TILES in self.tags
        self.offsets, self.sizes = (self.tags[t] for t in ((TILES, TILE_SIZES) if tiled else (STRIPS, STRIP_SIZES)))
        self.block = (self._one(TILE_HEIGHT), self._one(TILE_WIDTH)) if tiled else (min(self._one(ROWS, self.height), self.height), self.width)
        self.tiled = tiled
        text = self.tags.get(NODATA)
        self.nodata = float(text) if text else None

    def _one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise ValueError(f"{self.name}: tag {tag} is missing")
        return int(self.tags[tag][0]) if tag in self.tags else default

    def transform(self) -> tuple[float, ...] | None:
        """The geotransform, if the file has one."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return (m[3], m[0], m[1], m[7], m[4], m[5])
        if SCALE in self.tags and TIE in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIE]
            return (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
        return None

    def blocks(self) -> list[tuple[int, int, int]]:
        """(number, first row, first column) of every block of every plane."""
        (h, w), planes = self.block, self.samples if self.apart else 1
        across, down = -(-self.width // w), -(-self.height // h)
        return [(k, k // across % down * h, k % across * w) for k in range(planes * across * down)]

    def decoded(self, raw: bytes, k: int) -> np.ndarray:
        """Block k as (rows, columns, samples), cut to the image."""
        (h, w), n = self.block, 1 if self.apart else self.samples
        across, down = -(-self.width // w), -(-self.height // h)
        r0, c0 = k // across % down * h, k % across * w
        rows = h if self.tiled else min(h, self.height - r0)
        data = raw if self.compression == 1 else zlib.decompress(raw)
        size = self.dtype.itemsize
        if self.predictor == 3:  # bytes of equal weight stand together, as differences
            planes = np.cumsum(np.frombuffer(data, np.uint8, rows * w * n * size).reshape(rows, size * w, n), axis=1, dtype=np.uint8)
            parts = planes.reshape(rows, size, w, n)
            z = np.ascontiguousarray(np.moveaxis(parts, 1, 3)).view(">" + self.dtype.str[1:]).reshape(rows, w, n)
        else:
            z = np.frombuffer(data, self.dtype, rows * w * n).reshape(rows, w, n)
            if self.predictor == 2:
                z = np.cumsum(z, axis=1, dtype=self.dtype.newbyteorder("="))
        return z[: self.height - r0, : self.width - c0]


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return store, [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return store, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))


def _grid(file: str) -> str:
    return file.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def header(path: str) -> Header:
    """The header of one file."""
    store, files = _files(path)
    with store.open_input_file(files[0]) as f:
        return Header(f, files[0])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("block_bytes", 16 << 20))
        self.low, self.high, self.grid = {"r": None, "c": None}, {"r": None, "c": None}, None

    def pushFilters(self, filters):
        """Bounds choose blocks; Spark applies all filters again to the cells."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "grid_id" and isinstance(f, EqualTo):
                self.grid = f.value
            elif name in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(f.value, self.low[name]) if self.low[name] is not None else f.value
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(f.value, self.high[name]) if self.high[name] is not None else f.value
            yield f

    def _wanted(self, first: int, size: int, name: str) -> bool:
        low, high = self.low[name], self.high[name]
        return (low is None or first + size > low) and (high is None or first <= high)

    def partitions(self):
        out = []
        store, files = _files(self.path)
        for file in files:
            if self.grid is not None and _grid(file) != self.grid:
                continue
            with store.open_input_file(file) as f:
                h = Header(f, file)
            run, size = [], 0
            for k, r, c in h.blocks():
                if self._wanted(r, h.block[0], "r") and self._wanted(c, h.block[1], "c"):
                    run.append(k)
                    size += h.block[0] * h.block[1] * h.dtype.itemsize
                    if size >= self.most:
                        out.append(InputPartition((file, run)))
                        run, size = [], 0
            if run:
                out.append(InputPartition((file, run)))
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        file, run = partition.value
        store, _ = _files(self.path)
        with store.open_input_file(file) as f:
            h = Header(f, file)
            at = {k: (r, c) for k, r, c in h.blocks()}
            per = len(at) // h.samples if h.apart else len(at)
            for k in run:
                f.seek(h.offsets[k])
                z = h.decoded(f.read(h.sizes[k]), k).astype(float)
                if h.nodata is not None:
                    z[z == h.nodata] = np.nan
                rows, columns, n = z.shape
                r, c = (x.ravel() for x in np.meshgrid(np.arange(rows) + at[k][0], np.arange(columns) + at[k][1], indexing="ij"))
                for s in range(n):
                    band = k // per + 1 if h.apart else s + 1
                    yield pa.RecordBatch.from_arrays([pa.array([_grid(file)] * len(r)), pa.array(np.full(len(r), band, np.int32)), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(z[:, :, s].ravel())], names=["grid_id", "band", "r", "c", "z"])


class TiffSource(DataSource):
    """Cells of TIFF files: path (a file or a folder, by any address that Arrow opens), block_bytes."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_geotiff(spark: SparkSession, path: str, block_bytes: int = 16 << 20) -> DataFrame:
    """(grid_id, band, r, c, z) of a file or of a folder's files, grid_id being a file's name without its ending."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("geotiff").option("block_bytes", str(block_bytes)).load(path)


def encoded(z: np.ndarray, gt: Sequence[float], nodata: float, rows: int = 64) -> bytes:
    """A float32 image of one band as a file of deflated strips, with its geotransform (without rotation) and nodata."""
    height, width = z.shape
    strips = [zlib.compress(np.ascontiguousarray(z[i : i + rows], dtype="<f4").tobytes()) for i in range(0, height, rows)]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    text = f"{nodata:g}".encode() + b"\0"
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32]), (COMPRESSION, 3, [8]), (262, 3, [1]), (STRIPS, 4, offsets), (SAMPLES, 3, [1]), (ROWS, 4, [rows]),
        (STRIP_SIZES, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (FORMAT, 3, [3]), (SCALE, 12, [gt[1], -gt[5], 0.0]), (TIE, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0]), (NODATA, 2, text),
    ]
    extra_at, entries, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in fields:
        data = values if kind == 2 else struct.pack("<" + _SIZES[kind] * len(values), *values)
        if len(data) > 4:
            place = struct.pack("<I", extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def write_geotiffs(pixels: DataFrame, path: str, gt: Sequence[float], nodata: float = -9999.0, size: int = 2048) -> DataFrame:
    """pixels(grid_id, r, c, z) as a folder of files <grid_id>_<tile row>_<tile column>.tif, one task a tile; (file, rows, columns) of what was written.

    A file covers the tile's cells that are there, bounded by a box, and has its own geotransform; a repeated
    task writes the same file again.
    """
    gt = [float(x) for x in gt]
    if gt[2] or gt[4]:
        raise ValueError("a rotated geotransform cannot be written")
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(at, recursive=True)

    def kernel(table):
        own, to = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        r, c = table["r"].to_numpy(), table["c"].to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        z = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), nodata, np.float32)
        z[r - r0, c - c0] = table["z"].to_numpy()
        name = f"{table['grid_id'][0].as_py()}_{table['tr'][0].as_py()}_{table['tc'][0].as_py()}.tif"
        with own.open_output_stream(f"{to}/{name}") as f:
            f.write(encoded(z, [gt[0] + c0 * gt[1], gt[1], 0.0, gt[3] + r0 * gt[5], 0.0, gt[5]], nodata))
        return pa.table({"file": [name], "rows": pa.array([z.shape[0]], pa.int32()), "columns": pa.array([z.shape[1]], pa.int32())})

    cells = spread(pixels.select("grid_id", "r", "c", gdal_cells("z", nodata).alias("z")), 0, size)
    return settled(cells.groupBy(*TILE).applyInArrow(kernel, "file string, rows int, columns int"))
