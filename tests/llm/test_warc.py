"""Archives: round trips, byte for byte."""

import base64
import hashlib

import pytest

from skyweave.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a", "<p>same</p>"),
    (2, "http://b", "<p>same</p>"),
    (9, None, "<p>other\r\n\r\nWARC/1.1\r\nß</p>"),
    (7, "http://c\r\nWARC-Type: revisit", ""),
    (3, "http://d", None),
    (None, "http://e", "<p>same</p>"),
    (None, "http://f", "<p>nobody's</p>"),
    (11, "http://g", "x" * 3_000_000),
    (2, "http://b", "<p>same</p>"),
    (12, "http://h", "\x00 and 💧"),
]


def made(spark, folder, rows, schema=SCHEMA, **how):
    warc.archive(spark.createDataFrame(rows, schema).repartition(3), str(folder), **how)
    return warc.opened(spark, str(folder))


def expected(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        first[h] = i if first.get(h) is None else first[h] if i is None else min(i, first[h])
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= min_bytes and i != first[h]
        out.append((i, "revisit" if again else "response", first[h] if again else None, base64.b32encode(hashlib.sha1(h).digest()).decode(), len(h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 12, 10**9])
def test_what_revisits_what(spark, tmp_path, least):
    found = made(spark, tmp_path / "a", ROWS, min_bytes=least)
    assert sorted(map(tuple, found.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes").collect()), key=str) == expected(ROWS, least)


def test_records_and_payloads(spark, tmp_path):
    found = made(spark, tmp_path / "a", ROWS).collect()
    pages = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert {(r["page_id"], bytes(r["payload"])) for r in found} == pages
    for r in found:
        head, record = bytes(r["head"]), bytes(r["record"])
        [(top, block)] = warc.parsed(record)
        http, _, body = block.partition(b"\r\n\r\n")
        assert head == top + http + b"\r\n\r\n" and record.endswith(b"\r\n\r\n")
        assert body == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
        assert f"Content-Length: {r['payload_bytes']}".encode() in http
    # Each payload is there once.
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == len({h for _, h in pages})


def test_files_and_back(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None][:-2]
    found = made(spark, tmp_path / "a", rows)
    warc.export(found, str(tmp_path / "w"))
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert content.count(b"WARC-Record-ID") == len(rows)
    back = sorted(map(tuple, warc.read_files(spark, str(tmp_path / "w")).collect()), key=str)
    responses = {(r["page_id"], bytes(r["payload"]).decode()) for r in found.collect() if r["record_type"] == "response"}
    assert {(i, h) for i, _, h in back} == responses


def test_damage_is_noticed(spark, tmp_path):
    found = made(spark, tmp_path / "a", ROWS[:3])
    spark.read.parquet(str(tmp_path / "a" / "payloads")).selectExpr("address", "cast('no' as binary) payload").write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "records")).write.parquet(str(tmp_path / "b" / "records"))
    assert found.count() == 3
    with pytest.raises(Exception, match="not that of its address"):
        warc.opened(spark, str(tmp_path / "b")).select("payload_digest").collect()


def test_empty_and_clashing(spark, tmp_path):
    assert made(spark, tmp_path / "a", []).count() == 0
    named = made(spark, tmp_path / "b", [(1, "u", "h", "x", "y", 3)], SCHEMA + ", payload string, address string, first long")
    assert [r["record_type"] for r in named.collect()] == ["response"]


def test_base32(spark):
    df = spark.createDataFrame([(b"",), (b"abc",)], "b binary")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(warc.base32(F.sha1("b"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(b).digest()).decode() for b in (b"", b"abc")]
