"""Polygons of shapefiles: the public .shp and .dbf formats."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.session import ship

from .places import ZONES

# The types that are polygons (plain, with heights, with measures).
POLYGONS = (5, 15, 25)


#: Records that a task hands on at a time.
MANY = 2000
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def shapes(raw: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The rings of each record; None where it is no polygon."""
    at = 100
    while at + 8 <= len(raw):
        size = struct.unpack_from(">i", raw, at + 4)[0] * 2
        body, at = raw[at + 8 : at + 8 + size], at + 8 + size
        if struct.unpack_from("<i", body)[0] not in POLYGONS:
            yield None
            continue
        parts, points = struct.unpack_from("<ii", body, 36)
        first = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        pairs = list(zip(flat[::2], flat[1::2]))
        yield [pairs[a:b] for a, b in zip(first, first[1:])]


def header(raw: bytes) -> list[tuple[str, int, int]]:
    """``(name, start, size)`` of a .dbf file's fields within a row."""
    out, at, start = [], 32, 1
    while raw[at] != 0x0D:
        size = raw[at + 16]
        out.append((raw[at : at + 11].split(b"\0")[0].decode(), start, size))
        at, start = at + 32, start + size
    return out


def values(raw: bytes, field: str, encoding: str = "utf-8") -> Iterator[str]:
    """A field of each row, as text."""
    count, head, width = struct.unpack_from("<IHH", raw, 4)
    found = [(start, size) for name, start, size in header(raw) if name == field]
    if not found:
        raise KeyError(f"no field {field!r}; there are {', '.join(n for n, *_ in header(raw))}")
    start, size = found[0]
    for k in range(count):
        at = head + k * width + start
        yield raw[at : at + size].decode(encoding, "replace").strip()


def _each(spark: SparkSession, path: str, make: Callable[[bytes], Iterator], kind: pa.DataType, schema: str) -> DataFrame:
    """``(layer, record, value)`` of what ``make`` finds in files, each in the
    task that reads it; a layer is a path without its ending."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = enumerate(make(content.as_py()))
                while part := list(itertools.islice(found, MANY)):
                    records, items = zip(*part)
                    if pa.types.is_list(kind):
                        items = [rings and [[{"x": x, "y": y} for x, y in r] for r in rings] for rings in items]
                    yield pa.RecordBatch.from_arrays([pa.array([where[:-4]] * len(part)), pa.array(records, pa.int64()), pa.array(items, kind)], names=["layer", "record", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"layer string, record long, value {schema}")


def read(spark: SparkSession, path: str, field: str, encoding: str = "utf-8") -> DataFrame:
    """Zones of the shapefile ``path`` (.shp, with a .dbf beside it), or of all
    that a pattern such as ``folder/*.shp`` fits, named by ``field``. Records
    with one name are united; what is no polygon is left out, and so is a
    record that one of the two files lacks. A file is one task's; records meet
    by layer and number."""
    rings = _each(spark, path, shapes, _RINGS, ZONES.split(" ", 3)[3]).where("value is not null")
    named = _each(spark, path[:-4] + ".dbf", lambda raw: values(raw, field, encoding), pa.string(), "string").withColumnRenamed("value", "zone")
    return rings.join(named, ["layer", "record"]).groupBy("zone").agg(F.flatten(F.collect_list("value")).alias("rings"))


def fields(spark: SparkSession, path: str) -> list[str]:
    """Names of the attributes, in order."""
    found = _each(spark, path[:-4] + ".dbf", lambda raw: (name for name, *_ in header(raw)), pa.string(), "string")
    return [r["value"] for r in found.orderBy("layer", "record").collect()]  # one a column of the table
