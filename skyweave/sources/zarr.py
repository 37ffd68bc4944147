"""Zarr stores (format 2) as observations.

A chunk of an array is a file, so chunks are Spark's to deal out: each is
decoded where it is read and its cells become rows. Only the arrays'
descriptions and the axes, which are short, are read by the driver.
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.session import ship

#: Units of time axes, in days.
UNITS = {"days": 1.0, "hours": 1 / 24, "minutes": 1 / 1440, "seconds": 1 / 86400}
#: The compressors that a blosc block may have, by number.
BLOSC = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def _plain(codec: str, data: bytes, size: int) -> bytes:
    if codec in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    return pa.Codec(codec).decompress(data, size).to_pybytes()


def blosc(data: bytes) -> bytes:
    """A blosc frame's content: blocks that begin at listed places, each of one
    stream, or of one for every byte of an element; bytes of like rank may
    stand together (shuffle)."""
    flags, typesize = data[2], data[3]
    total, block, _ = np.frombuffer(data, "<u4", 3, 4).tolist()
    if flags & 2:
        return data[16 : 16 + total]
    if flags & 4 or flags >> 5 not in BLOSC:
        raise ValueError("blosc frames with bit shuffle or blosclz are not read")
    count = -(-total // block)
    out = []
    for k, at in enumerate(np.frombuffer(data, "<i4", count, 16).tolist()):
        size = min(block, total - k * block)
        streams = typesize if not flags & 16 and size == block else 1
        parts = []
        for _ in range(streams):
            length = int.from_bytes(data[at : at + 4], "little")
            own = data[at + 4 : at + 4 + length]
            parts.append(own if length == size // streams else _plain(BLOSC[flags >> 5], own, size // streams))
            at += 4 + length
        raw = b"".join(parts)
        if flags & 1 and typesize > 1:
            whole = size - size % typesize
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(typesize, -1).T.tobytes() + raw[whole:]
        out.append(raw)
    return b"".join(out)


def decode(content: bytes, meta: dict) -> np.ndarray:
    """A chunk as an array of the chunk's shape."""
    shape, kind = meta["chunks"], np.dtype(meta["dtype"])
    codec = (meta.get("compressor") or {}).get("id")
    size = int(np.prod(shape)) * kind.itemsize
    raw = content if codec is None else blosc(content) if codec == "blosc" else _plain(codec, content, size)
    return np.frombuffer(raw, kind).reshape(shape, order=meta.get("order", "C"))


def _json(spark: SparkSession, path: str) -> dict:
    """A small file whose name begins with a dot, which Spark's readers pass
    over; none is an empty description."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    stream = fs.open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def described(spark: SparkSession, path: str, name: str) -> tuple[dict, dict]:
    """An array's description and attributes."""
    meta = _json(spark, f"{path}/{name}/.zarray")
    if not meta:
        raise FileNotFoundError(f"no array {name!r} in {path}")
    if meta.get("zarr_format") != 2 or meta.get("filters"):
        raise ValueError(f"{name}: only format 2 without filters is read")
    return meta, _json(spark, f"{path}/{name}/.zattrs")


def _chunks(spark: SparkSession, path: str, name: str, ranges: list[tuple[int, int]] | None = None, separator: str = ".") -> DataFrame | None:
    """Files of an array's chunks; with ``ranges``, only those whose places
    lie in them, none where there is not one such file."""
    files = spark.read.format("binaryFile")
    if ranges is None:
        return files.option("recursiveFileLookup", True).load(f"{path}/{name}").select("path", "content")
    glob = separator.join("{" + ",".join(map(str, range(a, b))) + "}" for a, b in ranges)
    try:
        return files.load(f"{path}/{name}/{glob}").select("path", "content")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _place(path: str, name: str, dims: int) -> list[int] | None:
    """A chunk's place in the array, from the end of its path."""
    tail = path.rsplit(f"/{name}/", 1)[-1]
    return [int(x) for x in re.split(r"[./]", tail)] if re.fullmatch(r"\d+([./]\d+)*", tail) and len(re.split(r"[./]", tail)) == dims else None


def axis(spark: SparkSession, path: str, name: str) -> np.ndarray:
    """A coordinate, whole: as long as one side of the grid."""
    meta, _ = described(spark, path, name)
    out = np.full(meta["shape"][0], np.nan, np.dtype(meta["dtype"]).newbyteorder("=") if np.dtype(meta["dtype"]).kind == "f" else np.float64)
    for row in _chunks(spark, path, name).collect():
        place = _place(row["path"], name, 1)
        if place:
            part = decode(bytes(row["content"]), meta)
            at = place[0] * meta["chunks"][0]
            out[at : at + len(part)] = part[: len(out) - at]
    return out.astype(np.float64)


def dates(values: np.ndarray, units: str) -> np.ndarray:
    """Days of a time axis ``… since …``, as numbers from 1970 on."""
    unit, _, since = units.partition(" since ")
    start = dt.date.fromisoformat(since.strip()[:10])
    return np.floor(values * UNITS[unit.strip().lower()] + 1e-9).astype(np.int64) + (start - dt.date(1970, 1, 1)).days


CELLS = "time date, lat_i int, lon_i int, lat double, lon double, value double"
#: A part of a grid: steps, rows and columns from one to before another.
Window = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


@dataclass(frozen=True)
class Cube:
    """A variable on dimensions time, lat and lon, in that order, with its
    axes: days since 1970, and degrees."""

    meta: dict
    attrs: dict
    days: np.ndarray
    lats: np.ndarray
    lons: np.ndarray

    def __post_init__(self):
        if len(self.meta["shape"]) != 3:
            raise ValueError("a variable is not on time, lat and lon")

    def window(self, days: tuple[float, float], lats: tuple[float, float], lons: tuple[float, float]) -> Window | None:
        """The least part that holds all steps and cells between the given
        values, ends included; none where there are none. Axes may run either
        way, or in no order."""
        out = []
        for values, (low, high), n in zip((self.days, self.lats, self.lons), (days, lats, lons), self.meta["shape"]):
            at = np.flatnonzero((values[:n] >= low) & (values[:n] <= high))
            if not len(at):
                return None
            out.append((int(at[0]), int(at[-1]) + 1))
        return tuple(out)

    def places(self, window: Window) -> list[tuple[int, int, int]]:
        """The chunks that a window touches."""
        return list(itertools.product(*(range(a // c, -(-b // c)) for (a, b), c in zip(window, self.meta["chunks"]))))

    def name(self, place: tuple[int, int, int]) -> str:
        return self.meta.get("dimension_separator", ".").join(map(str, place))

    def cells(self, content: bytes, place: list[int], window: Window | None = None) -> Iterator[pa.RecordBatch]:
        """A chunk's cells within the window, one step at a time. Scale and
        offset are applied; fill values and NaN are null."""
        fills = [float(x) for x in (self.meta.get("fill_value"), self.attrs.get("_FillValue"), self.attrs.get("missing_value")) if x is not None and x != "NaN"]
        scale, offset = self.attrs.get("scale_factor", 1.0), self.attrs.get("add_offset", 0.0)
        at = [p * c for p, c in zip(place, self.meta["chunks"])]
        window = window or tuple((0, n) for n in self.meta["shape"])
        part = [(max(a, x), min(a + c, y)) for a, c, (x, y) in zip(at, self.meta["chunks"], window)]
        if any(x >= y for x, y in part):
            return
        block = decode(content, self.meta)[tuple(slice(x - a, y - a) for a, (x, y) in zip(at, part))]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(*part[1]), np.arange(*part[2]), indexing="ij"))
        for k, field in enumerate(block):
            v = field.ravel().astype(np.float64)
            gone = ~np.isfinite(v) | np.isin(v, fills)
            day = np.full(len(v), self.days[part[0][0] + k], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(day).cast(pa.date32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(self.lats[i]), pa.array(self.lons[j]), pa.array(v * scale + offset, mask=gone)],
                names=["time", "lat_i", "lon_i", "lat", "lon", "value"],
            )


def day_number(day: str | dt.date | None, other: float) -> float:
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return other if day is None else float((day - dt.date(1970, 1, 1)).days)


def read_zarr(
    spark: SparkSession, path: str, variable: str, time: str = "time", lat: str = "lat", lon: str = "lon",
    start: str | None = None, end: str | None = None, box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """``(time, lat_i, lon_i, lat, lon, value)`` of a variable on dimensions
    time, lat and lon, in that order, from ``start`` to ``end`` and in the box
    (west, south, east, north), if there are such.

    Which chunks hold these follows from the axes; only their files are opened,
    by any file system that Spark reads. ``scale_factor`` and ``add_offset`` are
    applied; fill values and NaN are null; a chunk that is not there has no
    rows. Compressors are none, zlib, gzip, zstd, lz4 and blosc with these."""
    meta, attrs = described(spark, path, variable)
    days = dates(axis(spark, path, time), described(spark, path, time)[1]["units"])
    cube = Cube(meta, attrs, days, axis(spark, path, lat), axis(spark, path, lon))
    west, south, east, north = box or (-np.inf, -np.inf, np.inf, np.inf)
    window = cube.window((day_number(start, -np.inf), day_number(end, np.inf)), (south, north), (west, east))
    if window is None:
        return spark.createDataFrame([], CELLS)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = _place(where, variable, 3)
                if place is not None:
                    yield from cube.cells(content.as_py(), place, window)

    chosen = _chunks(spark, path, variable, [(a // c, -(-b // c)) for (a, b), c in zip(window, meta["chunks"])], meta.get("dimension_separator", "."))
    found = spark.createDataFrame([], CELLS) if chosen is None else chosen.mapInArrow(run, CELLS)
    if start:
        found = found.where(F.col("time") >= F.lit(start).cast("date"))
    if end:
        found = found.where(F.col("time") <= F.lit(end).cast("date"))
    return found if box is None else found.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
