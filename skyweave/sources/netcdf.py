"""Fields in the classic netCDF format, one file a step.

The format is public: a header of dimensions, attributes and variables in
big-endian numbers, then the variables' values one after another. Reading
happens in the tasks, from bytes that Spark fetches, so any store will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.session import ship

# The format's tags and types.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"int32": 4, "float32": 5, "float64": 6}


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + _pad(raw)


def _attributes(values: dict) -> bytes:
    if not values:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTE, len(values))
    for k, v in values.items():
        if isinstance(v, str):
            raw = v.encode()
            out += _text(k) + struct.pack(">ii", 2, len(raw)) + _pad(raw)
        else:
            data = np.atleast_1d(v)
            code = 4 if data.dtype.kind == "i" else 5 if data.dtype == np.float32 else 6
            out += _text(k) + struct.pack(">ii", code, data.size) + _pad(data.astype(TYPES[code]).tobytes())
    return out


def encode(dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A file's bytes from dimensions and variables ``name: (dimensions,
    values, attributes)``."""
    names = list(dimensions)
    data = {k: (CODES[str(v[1].dtype)], _pad(np.ascontiguousarray(v[1]).astype(TYPES[CODES[str(v[1].dtype)]]).tobytes())) for k, v in variables.items()}

    def header(begin: int) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", 0)
        out += struct.pack(">ii", DIMENSION, len(names)) + b"".join(_text(k) + struct.pack(">i", dimensions[k]) for k in names)
        out += _attributes(attributes or {})
        out += struct.pack(">ii", VARIABLE, len(variables))
        for k, (dims, _, attrs) in variables.items():
            code, raw = data[k]
            out += _text(k) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", names.index(d)) for d in dims)
            out += _attributes(attrs) + struct.pack(">iiq", code, len(raw), begin)
            begin += len(raw)
        return out

    return header(len(header(0))) + b"".join(raw for _, raw in data.values())


def decode(raw: bytes) -> tuple[dict, dict]:
    """``(variables, attributes)`` of a file; a variable is ``(dimensions,
    values, attributes)``. Files with records are not read."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("not a classic netCDF file")
    wide, at = raw[3] == 2, 8

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", raw, at - 4)[0]

    def text() -> str:
        nonlocal at
        n = number()
        s = raw[at : at + n].decode()
        at += n + -n % 4
        return s

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            k, code, n = text(), number(), number()
            size = n * np.dtype(TYPES[code]).itemsize
            v = raw[at : at + size]
            out[k] = v.decode() if code == 2 else np.frombuffer(v, TYPES[code]).astype(np.dtype(TYPES[code]).newbyteorder("="))
            at += size + -size % 4
        return out

    number()
    dims = [(text(), number()) for _ in range(number())]
    whole = attributes()
    number()
    variables = {}
    for _ in range(number()):
        name = text()
        mine = [dims[number()] for _ in range(number())]
        attrs, code, _ = attributes(), number(), number()
        begin = struct.unpack_from(">q" if wide else ">i", raw, at)[0]
        at += 8 if wide else 4
        if any(size == 0 for _, size in mine):
            raise ValueError(f"{name} has records")
        count = int(np.prod([size for _, size in mine])) if mine else 1
        values = np.frombuffer(raw, TYPES[code], count, begin).astype(np.dtype(TYPES[code]).newbyteorder("=")).reshape([size for _, size in mine])
        variables[name] = (tuple(d for d, _ in mine), values, attrs)
    return variables, whole


def read_fields(spark: SparkSession, folder: str, pattern: str, variable: str, lat: str = "lat", lon: str = "lon", missing: float | None = None) -> DataFrame:
    """``(time, lat_i, lon_i, lat, lon, value)`` of all files in ``folder``
    whose names hold a date by ``pattern``; the missing value, that of the file
    or the one given, and NaN are null. Rows run from south to north."""
    ship(spark)
    glob = pattern.replace("%Y", "*").replace("%m", "*").replace("%-d", "*").replace("%d", "*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    dated = files.withColumn("time", C.file_date(F.substring_index("path", "/", -1), pattern)).where("time is not null").select("time", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for time, raw in zip(batch.column(0), batch.column(1)):
                found, _ = decode(raw.as_py())
                dims, values, attrs = found[variable]
                field = values.astype(float).reshape([s for d, s in zip(dims, values.shape) if d in (lat, lon)])
                if dims.index(lon) < dims.index(lat):
                    field = field.T
                y, x = found[lat][1].astype(float), found[lon][1].astype(float)
                order = np.argsort(y)
                y, field = y[order], field[order]
                none = missing if missing is not None else attrs.get("_FillValue", attrs.get("missing_value"))
                gone = np.isnan(field) | (field == float(np.atleast_1d(none)[0]) if none is not None else False)
                i, j = (k.ravel() for k in np.indices(field.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([time.as_py()] * field.size, pa.date32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(y[i]), pa.array(x[j]), pa.array(field.ravel(), mask=gone.ravel())],
                    names=["time", "lat_i", "lon_i", "lat", "lon", "value"],
                )

    return dated.mapInArrow(run, "time date, lat_i int, lon_i int, lat double, lon double, value double")


def field_bytes(grid: DataFrame, values: list[str], missing: float = -9999.0, units: dict[str, str] | None = None, limit: int = 4_000_000) -> bytes:
    """A file of one field a column in ``values`` from ``(lat, lon, values…)``.
    The grid is collected after it was counted to have at most ``limit`` cells."""
    if grid.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} cells; keep them as a table instead")
    found = grid.select("lat", "lon", *values).toPandas()
    y, x = np.sort(found["lat"].unique()), np.sort(found["lon"].unique())
    at = (np.searchsorted(y, found["lat"]), np.searchsorted(x, found["lon"]))
    variables = {"lat": (("lat",), y, {"units": "degrees_north"}), "lon": (("lon",), x, {"units": "degrees_east"})}
    for v in values:
        field = np.full((len(y), len(x)), missing, np.float32)
        field[at] = found[v].astype(float).fillna(missing)
        variables[v] = (("lat", "lon"), field, {"_FillValue": np.float32(missing), "units": (units or {}).get(v, "")})
    return encode({"lat": len(y), "lon": len(x)}, variables)


def write_field(grid: DataFrame, values: list[str], path: str, **how) -> None:
    Path(path).write_bytes(field_bytes(grid, values, **how))
