"""A content-addressed web archive.

The bytes of a payload are stored once, under their SHA-256; records keep
their own headers, byte for byte, in a table of their own, and a record is put
together again by joining the two. Plain WARC files can be made of an archive,
and be read into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.session import ship

#: The alphabet of base32, the profile of revisit records.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32(hexed: Column) -> Column:
    """160 bits, given as 40 hexadecimal digits, in base32."""
    out = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _head(page_id: Column, url: Column, digest: Column, size: Column, first: Column, date: str) -> Column:
    """The bytes of a record before its payload: WARC and HTTP headers; the
    page it revisits in ``first``, null for a response."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    # A line break in an address would end its header.
    target = F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\r\n"))
    kind = F.when(first.isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    refers = F.concat(F.lit("WARC-Refers-To: "), _urn(first), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    block = F.octet_length(http) + F.when(first.isNull(), size).otherwise(F.lit(0))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _urn(page_id), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(target, F.lit("")), F.when(first.isNull(), F.lit("")).otherwise(refers), F.lit("WARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END), http,
    )
    return lines.cast("binary")


def archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages(page_id, url, html)`` as an archive at ``path``: tables
    ``payloads(address, payload, bytes, sha1, first)`` and ``records(page_id,
    address, head)``.

    A record is a response, but where payloads of ``min_bytes`` bytes or more
    are equal, all but those of the least page_id revisit that one. Null html
    is an empty payload, a null url is left out of the header. Null ids come
    after others, and where all of a group are null all are responses; so are
    rows that repeat the least id. Repeated rows are records each; an empty
    table makes an empty archive; other columns do not matter.

    Equal payloads are combined in the tasks that read them before they are
    shuffled, so copies cost no more than one each a task. Payloads of one
    address that differ in length or SHA-1 are an error."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("address"))
    facts = rows.withColumns({"_n": F.octet_length("payload").cast("long"), "_sha1": F.sha1("payload")})
    kept = facts.groupBy("address").agg(
        F.any_value("payload").alias("payload"), F.min("page_id").alias("first"), F.min("_n").alias("bytes"), F.max("_n").alias("_n"), F.min("_sha1").alias("sha1"), F.max("_sha1").alias("_sha1")
    )
    same = (F.col("bytes") == F.col("_n")) & (F.col("sha1") == F.col("_sha1"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("one address for two payloads")).cast("binary"))
    kept.select("address", checked.alias("payload"), "bytes", "sha1", "first").write.parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "bytes", "sha1", "first")
    joined = rows.select("page_id", "url", "address").join(stored, "address")
    again = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = _head(F.col("page_id"), F.col("url"), base32(F.col("sha1")), F.col("bytes"), F.when(again, F.col("first")), date)
    joined.select("page_id", "address", head.alias("head")).write.parquet(f"{path}/records")


def _field(head: Column, name: str) -> Column:
    """A WARC header's value, null where it is not there."""
    return F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``(page_id, record_type, refers_to,
    payload_digest, payload_bytes, head, payload, record)``. Headers are read
    from ``head``; ``payload`` is that of the address, for revisits too, and
    ``record`` the record's bytes as a WARC file has them. A payload whose
    digest is not its address, or not the header's, is an error."""
    stored = spark.read.parquet(f"{path}/payloads").select("address", "payload")
    good = F.unhex(F.sha2("payload", 256)) == F.col("address")
    stored = stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a payload is not that of its address")).cast("binary")))
    stored = stored.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "_digest": base32(F.sha1("payload"))})
    rows = spark.read.parquet(f"{path}/records").join(stored, "address")
    text = F.substring_index(F.col("head").cast("string"), END, 1)
    told = F.substring_index(_field(text, "WARC-Payload-Digest"), ":", -1)
    refers = F.regexp_extract(F.coalesce(_field(text, "WARC-Refers-To"), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    digest = F.when(told == F.col("_digest"), F.col("_digest")).otherwise(F.raise_error(F.lit("a payload is not that of its header")))
    kind = _field(text, "WARC-Type")
    record = F.concat("head", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(END.encode()))
    return rows.select("page_id", kind.alias("record_type"), F.nullif(refers, F.lit("")).cast("long").alias("refers_to"), digest.alias("payload_digest"), "payload_bytes", "head", "payload", record.alias("record"))


def export(records: DataFrame, folder: str, compression: str = "none") -> None:
    """Write ``record`` of :func:`opened` as WARC files, a task's records in
    one each. Payloads are text, so Spark's own writer can take them."""
    text = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - len(END)).cast("string")
    records.select(text.alias("value")).write.option("lineSep", END).option("compression", compression).text(folder)


def parsed(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """``(head, block)`` of the records of a WARC file, one after the other."""
    at = 0
    while (end := content.find(END.encode(), at)) >= 0:
        head = content[at : end + 4]
        size = next((int(line.split(b":", 1)[1]) for line in head.lower().split(b"\r\n") if line.startswith(b"content-length:")), None)
        if size is None:
            raise ValueError("a record has no Content-Length")
        yield head, content[end + 4 : end + 4 + size]
        at = end + 4 + size + len(END)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, html)`` of the responses in WARC files, to archive
    them; ``page_id`` is null where the record's id is no page's. A file is
    read by one task, whole: files of a gigabyte, as is usual, fit."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string())
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for head, block in parsed(content.as_py()):
                    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
                    if fields.get("WARC-Type") != "response":
                        continue
                    held.append((fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), block.partition(END.encode())[2].decode("utf-8", "replace")))
                    size += len(block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), kinds)], names=["id", "url", "html"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), kinds)], names=["id", "url", "html"])

    rows = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, "id string, url string, html string")
    number = F.regexp_extract(F.coalesce("id", F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    return rows.select(F.nullif(number, F.lit("")).cast("long").alias("page_id"), "url", "html")


_B32 = "list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('" + BASE32 + "', CAST((CAST('0x' || substr(sha1(h), 5 * k + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '')"

#: The same in DuckDB, for payloads of any length.
SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(h) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN f USING (h)"""
