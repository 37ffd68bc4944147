import datetime as dt
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skyweave.sources import zarr


def blosc(raw, typesize, block, codec="lz4_raw", number=1, split=True, shuffle=True):
    """A blosc frame by its definition."""
    starts, body = [], b""
    count = -(-len(raw) // block)
    for k in range(count):
        part = raw[k * block : (k + 1) * block]
        if shuffle:
            part = np.frombuffer(part, np.uint8).reshape(-1, typesize).T.tobytes()
        streams = typesize if split and len(part) == block else 1
        starts.append(16 + 4 * count + len(body))
        for s in range(streams):
            own = part[s * len(part) // streams : (s + 1) * len(part) // streams]
            packed = zlib.compress(own) if codec == "zlib" else pa.Codec(codec).compress(own).to_pybytes()
            packed = packed if len(packed) < len(own) else own
            body += len(packed).to_bytes(4, "little") + packed
    flags = (1 if shuffle else 0) | (0 if split else 16) | number << 5
    head = bytes([2, 1, flags, typesize]) + np.array([len(raw), block, 16 + 4 * count + len(body)], "<u4").tobytes()
    return head + np.array(starts, "<i4").tobytes() + body


@pytest.mark.parametrize(("codec", "number"), [("lz4_raw", 1), ("snappy", 2), ("zlib", 3), ("zstd", 4)])
def test_blosc(codec, number):
    rng = np.random.default_rng(1)
    for n, split, shuffle in ((5000, True, True), (5000, False, True), (777, True, False), (3, True, True)):
        raw = (rng.integers(0, 50, n).astype("<f4")).tobytes()
        assert zarr.blosc(blosc(raw, 4, 4096, codec, number, split, shuffle)) == raw
    raw = bytes(range(100))
    assert zarr.blosc(bytes([2, 1, 2, 1]) + np.array([100, 100, 116], "<u4").tobytes() + raw) == raw


def write(folder, name, array, chunks, compressor, attrs=None, fill=None, order="C", sep=".", skip=()):
    top = folder / name
    top.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": array.shape, "chunks": chunks, "dtype": array.dtype.str, "compressor": compressor, "fill_value": fill, "filters": None, "order": order}
    (top / ".zarray").write_text(json.dumps(meta | {"dimension_separator": sep}))
    (top / ".zattrs").write_text(json.dumps(attrs or {}))
    for place in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, chunks)]):
        if place in skip:
            continue
        block = np.zeros(chunks, array.dtype)
        part = array[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes(order)
        kind = (compressor or {}).get("id")
        raw = {None: lambda: raw, "zlib": lambda: zlib.compress(raw), "zstd": lambda: pa.Codec("zstd").compress(raw).to_pybytes(), "blosc": lambda: blosc(raw, array.dtype.itemsize, 256)}[kind]()
        file = top / sep.join(map(str, place))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)


@pytest.mark.parametrize(("kind", "order", "sep"), [("zlib", "C", "."), ("zstd", "F", "/"), ("blosc", "C", "."), (None, "C", "/")])
def test_reads_what_is_there(spark, tmp_path, kind, order, sep):
    rng = np.random.default_rng(2)
    compressor = {"id": kind} if kind else None
    cube = rng.integers(0, 100, (7, 5, 6)).astype("<f4")
    cube[2, 1, 3], cube[4, 0, 0] = np.nan, -99
    lat, lon = np.linspace(2, -2, 5), np.linspace(30, 32.5, 6).astype("<f4")
    write(tmp_path, "rain", cube, (3, 2, 4), compressor, {"_FillValue": -99.0, "scale_factor": 0.5, "add_offset": 1.0}, "NaN", order, sep, skip={(1, 0, 1)})
    write(tmp_path, "lat", lat, (3,), compressor)
    write(tmp_path, "lon", lon, (6,), compressor)
    write(tmp_path, "time", np.arange(7, dtype="<i8") * 24, (7,), compressor, {"units": "hours since 2001-03-01 00:00:00"})
    found = {(r["time"], r["lat_i"], r["lon_i"]): r for r in zarr.read_zarr(spark, str(tmp_path), "rain").collect()}
    absent = {(k, i, j) for k in range(3, 6) for i in range(2) for j in range(4, 6)}
    assert len(found) == cube.size - len(absent)
    for (k, i, j), v in np.ndenumerate(cube):
        r = found.get((dt.date(2001, 3, 1) + dt.timedelta(k), i, j))
        if (k, i, j) in absent:
            assert r is None
            continue
        assert r["lat"] == lat[i] and abs(r["lon"] - float(lon[j])) < 1e-6
        assert r["value"] == (None if np.isnan(v) or v == -99 else float(v) * 0.5 + 1)


def test_says_what_it_does_not_read(spark, tmp_path):
    write(tmp_path, "x", np.zeros((2, 2, 2), "<f4"), (2, 2, 2), None)
    with pytest.raises(FileNotFoundError):
        zarr.read_zarr(spark, str(tmp_path), "y")
    meta = json.loads((tmp_path / "x" / ".zarray").read_text())
    (tmp_path / "x" / ".zarray").write_text(json.dumps(meta | {"filters": [{"id": "delta"}]}))
    with pytest.raises(ValueError):
        zarr.read_zarr(spark, str(tmp_path), "x")
