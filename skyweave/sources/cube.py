"""Zarr stores as a data source: ``spark.read.format("skyweave_zarr")``.

Reads are planned from the axes: conditions on time and place are taken over,
and only the chunks that may hold such cells become partitions. Writes come in
two phases: tasks put whole chunks aside, and only when all of them have done
so are chunks moved into place and the array's description replaced, which is
what makes new steps visible.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from skyweave.operators.support import Axes
from skyweave.session import ship

from .zarr import CELLS, Cube, Window, dates, decode

NAME = "skyweave_zarr"
#: Cells that a partition reads, about.
READ = 1 << 22
#: Steps in a chunk of the axis of time; it is short and is written whole.
_STEPS = 1 << 16


class Folder:
    """A store's files, by whatever file system its path names."""

    def __init__(self, path: str):
        self.fs, self.top = files.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (files.LocalFileSystem(), path)

    def at(self, name: str) -> str:
        return f"{self.top}/{name}"

    def read(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(self.at(name), compression=None) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, name: str, content: bytes) -> None:
        """A file appears whole or not at all."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.at(name).rpartition("/")[0])
        with self.fs.open_output_stream(self.at(aside), compression=None) as f:
            f.write(content)
        self.move(aside, name)

    def move(self, old: str, new: str) -> None:
        self.fs.create_dir(self.at(new).rpartition("/")[0])
        self.fs.move(self.at(old), self.at(new))

    def drop(self, name: str) -> None:
        try:
            self.fs.delete_dir(self.at(name))
        except FileNotFoundError:
            pass

    def json(self, name: str) -> dict:
        return json.loads(self.read(name) or b"{}")

    def axis(self, name: str) -> np.ndarray:
        meta = self.json(f"{name}/.zarray")
        if not meta:
            raise FileNotFoundError(f"no array {name!r} in {self.top}")
        n, c = meta["shape"][0], meta["chunks"][0]
        parts = [decode(self.read(f"{name}/{k}"), meta).astype(np.float64) for k in range(-(-n // c))]
        return np.concatenate([*parts, np.zeros(0)])[:n]

    def cube(self, variable: str, time: str = "time", lat: str = "lat", lon: str = "lon") -> Cube:
        meta = self.json(f"{variable}/.zarray")
        if not meta:
            raise FileNotFoundError(f"no array {variable!r} in {self.top}")
        if meta.get("zarr_format") != 2 or meta.get("filters"):
            raise ValueError(f"{variable}: only format 2 without filters is read")
        days = dates(self.axis(time), self.json(f"{time}/.zattrs")["units"])
        return Cube(meta, self.json(f"{variable}/.zattrs"), days, self.axis(lat), self.axis(lon))


@dataclass
class Part(InputPartition):
    places: list[tuple[int, int, int]]
    window: Window

    def __init__(self, places: list, window: Window):
        super().__init__(None)
        self.places, self.window = places, window


class Reader(DataSourceReader):
    """Bounds of time, lat, lon, lat_i and lon_i narrow what is planned. The
    conditions stay with Spark too: a window is as wide as its ends."""

    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options["variable"]
        self.names = [options.get(k, k) for k in ("time", "lat", "lon")]
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    @staticmethod
    def _number(v) -> float:
        return float((v - dt.date(1970, 1, 1)).days) if isinstance(v, dt.date) else float(v)

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("time", "lat", "lon", "lat_i", "lon_i"):
                values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else []
                values = [self._number(v) for v in values if v is not None]
                if values and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low[column] = max(self.low.get(column, -np.inf), min(values))
                if values and isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high[column] = min(self.high.get(column, np.inf), max(values))
            yield f

    def window(self, cube: Cube) -> Window | None:
        ends = lambda c: (self.low.get(c, -np.inf), self.high.get(c, np.inf))
        found = cube.window(ends("time"), ends("lat"), ends("lon"))
        if found is None:
            return None
        for k, c in ((1, "lat_i"), (2, "lon_i")):
            (a, b), (low, high) = found[k], ends(c)
            a, b = int(max(a, np.ceil(low))), int(min(b, np.floor(high) + 1))
            if a >= b:
                return None
            found = (*found[:k], (a, b), *found[k + 1 :])
        return found

    def partitions(self) -> list[Part]:
        cube = Folder(self.path).cube(self.variable, *self.names)
        window = self.window(cube)
        if window is None:
            return [Part([], ((0, 0),) * 3)]
        places = cube.places(window)
        many = max(1, READ // int(np.prod(cube.meta["chunks"])))
        return [Part(places[k : k + many], window) for k in range(0, len(places), many)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.places:
            return
        folder = Folder(self.path)
        cube = folder.cube(self.variable, *self.names)
        for place in partition.places:
            content = folder.read(f"{self.variable}/{cube.name(place)}")
            if content is not None:  # a chunk that is not there has no rows
                yield from cube.cells(content, place, partition.window)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # aside, in place


class Writer(DataSourceArrowWriter):
    """Rows ``(ct, ci, cj, t, i, j, value)`` come chunk by chunk: a chunk's
    place, and a cell's in it. What the chunk holds already stays."""

    def __init__(self, options: dict):
        self.path, self.variable, self.job = options["path"], options["variable"], options["job"]
        self.plan = json.loads(options["plan"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder, own, out = Folder(self.path), uuid.uuid4().hex, []
        meta = self.plan["meta"]
        place, block = None, None

        def put() -> None:
            name = meta["dimension_separator"].join(map(str, place))
            aside = f".staged-{self.job}/{own}/{name}"
            folder.write(aside, zlib.compress(block.tobytes(), 1))
            out.append((aside, f"{self.variable}/{name}"))

        for batch in iterator:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if place != tuple(key[a].tolist()):
                    if place is not None:
                        put()
                    place = tuple(key[a].tolist())
                    before = folder.read(f"{self.variable}/" + meta["dimension_separator"].join(map(str, place)))
                    block = decode(before, meta).copy() if before else np.full(meta["chunks"], np.nan, meta["dtype"])
                t, i, j = (batch.column(k).to_numpy()[a:b] for k in (3, 4, 5))
                block[t, i, j] = batch.column(6).to_numpy(zero_copy_only=False)[a:b]
        if place is not None:
            put()
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        """Chunks first, which no one sees beyond the old shape; then the axes;
        the variable's shape last."""
        folder = Folder(self.path)
        for m in messages:
            for aside, name in m.files if m else []:
                folder.move(aside, name)
        for name, values, kind, attrs in self.plan["axes"]:
            array, size = np.array(values, kind), _STEPS if name == "time" else len(values)
            for k in range(0, len(array), size):
                part = np.zeros(size, kind)
                part[: len(array[k : k + size])] = array[k : k + size]
                folder.write(f"{name}/{k // size}", part.tobytes())
            folder.write(f"{name}/.zattrs", json.dumps(attrs | {"_ARRAY_DIMENSIONS": [name]}).encode())
            folder.write(f"{name}/.zarray", json.dumps(described([len(array)], [size], kind, None, None)).encode())
        folder.write(".zgroup", b'{"zarr_format": 2}')
        folder.write(f"{self.variable}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": ["time", "lat", "lon"]}).encode())
        folder.write(f"{self.variable}/.zarray", json.dumps(self.plan["meta"]).encode())
        folder.drop(f".staged-{self.job}")

    def abort(self, messages: list[Staged | None]) -> None:
        Folder(self.path).drop(f".staged-{self.job}")


class ZarrSource(DataSource):
    """Options: ``path``; ``variable``; ``time``, ``lat``, ``lon`` where axes
    have other names. Local paths, and those of file systems that Arrow knows
    (s3, gs, hdfs, file); others are read by :func:`zarr.read_zarr`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def described(shape: list[int], chunks: list[int], kind: str, compressor: dict | None, fill: str | None) -> dict:
    return {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "compressor": compressor, "fill_value": fill, "filters": None, "order": "C", "dimension_separator": "."}


def read_cube(spark: SparkSession, path: str, variable: str, **names: str) -> DataFrame:
    """``(time, lat_i, lon_i, lat, lon, value)`` of a variable; conditions on
    these columns decide what is opened."""
    ship(spark)
    spark.dataSource.register(ZarrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("path", path).option("variable", variable).options(**names).load()


def append_cube(obs: DataFrame, path: str, variable: str, axes: Axes, chunks: tuple[int, int, int] = (365, 64, 64), kind: str = "<f4") -> int:
    """Append the steps of ``obs(time, lat_i, lon_i, value)`` that the store at
    ``path`` does not have yet, the first call makes it; returns how many.

    Steps follow in order of time after those that are there. A step is
    appended once: of one that is there, nothing is changed. Cells that no row
    names are missing, as are those whose value is null or NaN; of rows equal in
    time and cell the greatest value stays. Rows without a time or outside the
    grid's ``rows`` and ``cols`` are left out. Chunks are dealt out whole, and
    tasks may run any number of times; a run that fails leaves nothing that
    can be seen, and running it again leaves what one run would. There may be
    one writer at a time."""
    spark = obs.sparkSession
    if not axes.rows or not axes.cols:
        raise ValueError("the grid's rows and columns must be known")
    folder = Folder(path)
    meta = folder.json(f"{variable}/.zarray")
    old: list[int] = dates(folder.axis("time")[: meta["shape"][0]], folder.json("time/.zattrs")["units"]).tolist() if meta else []
    chunks, kind = (tuple(meta["chunks"]), meta["dtype"]) if meta else (chunks, kind)
    if meta and (meta["shape"][1:] != [axes.rows, axes.cols] or meta["order"] != "C" or meta["compressor"] != {"id": "zlib", "level": 1}):
        raise ValueError(f"{variable} is kept on another grid or in another form")
    rows = obs.select(F.unix_date("time").alias("_day"), "lat_i", "lon_i", F.col("value").cast("double").alias("value"))
    rows = rows.where(F.col("_day").isNotNull() & F.col("lat_i").between(0, axes.rows - 1) & F.col("lon_i").between(0, axes.cols - 1))
    known = spark.createDataFrame([(d,) for d in old], "_day int")
    new = sorted(r["_day"] for r in rows.select("_day").distinct().join(known, "_day", "left_anti").collect())  # as long as the axis of time
    if not new:
        return 0
    place = spark.createDataFrame([(d, len(old) + k) for k, d in enumerate(new)], "_day int, _t int")
    into = lambda c, k: (F.floor(F.col(c) / chunks[k]).cast("int"), (F.col(c) % chunks[k]).cast("int"))
    (ct, t), (ci, i), (cj, j) = (into(c, k) for k, c in enumerate(("_t", "lat_i", "lon_i")))
    key = ["ct", "ci", "cj"]
    dealt = rows.join(F.broadcast(place), "_day").select(ct.alias("ct"), ci.alias("ci"), cj.alias("cj"), t.alias("t"), i.alias("i"), j.alias("j"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "t", "i", "j", F.isnan("value").desc(), "value")
    line = lambda start, step, n: [start + step * k for k in range(n)]
    plan = {
        "meta": described([len(old) + len(new), axes.rows, axes.cols], list(chunks), kind, {"id": "zlib", "level": 1}, "NaN"),
        "axes": [
            ("time", [*old, *new], "<i8", {"units": "days since 1970-01-01"}),
            ("lat", line(axes.lat0, axes.dlat, axes.rows), "<f8", {"units": "degrees_north"}),
            ("lon", line(axes.lon0, axes.dlon, axes.cols), "<f8", {"units": "degrees_east"}),
        ],
    }
    ship(spark)
    spark.dataSource.register(ZarrSource)
    dealt.write.format(NAME).mode("append").options(path=path, variable=variable, job=uuid.uuid4().hex, plan=json.dumps(plan)).save()
    return len(new)
