"""WARC archives with revisit resolution.

Records are written by Spark's text sink: each record ends with the format's
own terminator (CR LF CR LF), which is the sink's line separator, so archives
land in any store Spark writes to and a lost task rewrites only its own file.
Files are gzip streams and are read front to back by one task each; the reader
re-joins the pieces between terminators until a record's Content-Length is
reached, so payloads may hold anything.

Resolution works on headers alone: (digest, length, id) rows are reduced per
digest, the record with the largest id of each digest stays a response, and the
rest become revisit records that name it. Only the revisits' ids are joined
back to the records. The new archive gets fresh headers: new record ids, date
and block lengths; revisits carry their payload digest, profile and the
original's record id, URI and date, and no payload.

Defined cases: a null payload is empty, a null url gives a record without a
target URI, a null id an archive record without one (it sorts first, so it is a
response only where no copy has an id); repeated rows are records of their
own; ties on the id are broken by the record id; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import written

CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 20_000

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to_record", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def _base32_of_hex(digest: Column) -> Column:
    """Base32 text of a 40-digit hex SHA-1: five hex digits are four letters."""
    def four(i: int) -> list[Column]:
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(bits, k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*[c for i in range(8) for c in four(i)])


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value; line breaks can't get in."""
    safe = F.regexp_replace(value.cast("string"), r"[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"), *[_header(n, v) for n, v in headers],
                    _header("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def _new_id() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))


def _http(n_bytes: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    n_bytes.cast("string"), F.lit(END))


def _write(records: DataFrame, path: str) -> str:
    (records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> str:
    """A response record per row (page_id, url, html), payload the html."""
    body = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                      body.alias("body"), F.encode(body, "UTF-8").alias("raw"))
    block = F.concat(_http(F.octet_length("raw")), F.col("body"))
    headers = [("WARC-Record-ID", _new_id()), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")),
               ("X-Page-ID", F.col("page_id")), ("Content-Type", F.lit("application/http; msgtype=response")),
               ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32_of_hex(F.sha1("raw"))))]
    return _write(df.select(_record("response", headers, block).alias("value")), path)


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    pairs = (line.partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _hex(digest: str) -> str:
    """The hex form of a labelled digest in hex or Base32."""
    value = digest.partition(":")[2] or digest
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _records(pieces):
    """Records from a file's pieces, as split at the record terminator: the
    pieces with terminators between them are the file again, and lengths say
    where records end, so payloads may hold or end with parts of one."""
    sep, head, need, held = END.encode(), None, 0, bytearray()
    for piece in pieces:
        held += piece
        held += sep
        while True:
            if head is None:
                if held.startswith(sep):  # what the end of the file is short of
                    del held[:len(sep)]
                at = held.find(sep)
                if at < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not at the start of a WARC record")
                head = _parse(bytes(held[:at]))
                need = int(head["content-length"])
                del held[:at + len(sep)]
            if len(held) < need + len(sep):
                break
            if held[need:need + len(sep)] != sep:
                raise ValueError("a record's block is longer than its Content-Length")
            yield head, bytes(held[:need])
            del held[:need + len(sep)]
            head = None
    if head is not None or held.strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def _rows(head: dict[str, str], block: bytes, with_payload: bool) -> dict:
    _, _, payload = block.partition(END.encode())
    kind = head.get("warc-type")
    digest, n = _hex(head["warc-payload-digest"]), len(payload)
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't match its digest")
    else:
        n, payload = None, None
    page = head.get("x-page-id")
    return {"record_id": head["warc-record-id"], "record_type": kind, "page_id": int(page) if page else None,
            "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": digest,
            "payload_bytes": n, "refers_to_record": head.get("warc-refers-to"),
            "payload": payload if with_payload else None}


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of an archive folder. Payloads are checked against their
    digests; they are returned only if asked for."""
    pieces = (spark.read.option("lineSep", END).text(path)
              .select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")))
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                        ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers_to_record", pa.string()), ("payload", pa.binary())])

    def flow(batches):
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())

    def parse(batches):
        from itertools import groupby

        rows, held = [], 0
        for _, one in groupby(flow(batches), key=lambda x: x[0]):
            for head, block in _records(v for _, v in one):
                rows.append(_rows(head, block, with_payload))
                held += len(block) if with_payload else 200
                if held > 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pieces.mapInArrow(parse, RECORD)


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 1000,
                     date: str = "2024-06-01T00:00:00Z") -> str:
    """Write the archive at ``source`` anew at ``target``: of the responses
    with equal payloads of at least ``min_bytes`` the one with the largest page
    id stays, the rest and the source's own revisits become revisits of it."""
    heads = written(read_archive(spark, source).drop("payload"), "warc-headers")
    responses = heads.filter("record_type = 'response'")
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("order"), "record_id", "uri", "date"))
    groups = (responses.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
              .agg(best.alias("best"), F.count(F.lit(1)).alias("n")))
    shared = written(groups.filter("n > 1"), "warc-shared")
    again = (responses.join(shared, ["payload_digest", "payload_bytes"])
             .filter(F.col("record_id") != F.col("best.record_id"))
             .select("record_id", F.col("best.record_id").alias("to"), F.col("best.uri").alias("to_uri"),
                     F.col("best.date").alias("to_date")))
    firsts = responses.groupBy("payload_digest").agg(best.alias("best"))
    older = heads.filter("record_type = 'revisit'").join(firsts, "payload_digest").select(
        "record_id", F.col("best.record_id").alias("to"), F.col("best.uri").alias("to_uri"),
        F.col("best.date").alias("to_date"))
    again = written(again.unionByName(older), "warc-revisits")
    records = read_archive(spark, source, with_payload=True).join(again, "record_id", "left")
    fresh = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat("record_id", F.lit(date))),
                     "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    renamed = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat("to", F.lit(date))),
                       "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    common = [("WARC-Record-ID", fresh), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri")),
              ("X-Page-ID", F.col("page_id")), ("Content-Type", F.lit("application/http; msgtype=response")),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32_of_hex(F.col("payload_digest"))))]
    back = [("WARC-Refers-To", renamed), ("WARC-Refers-To-Target-URI", F.col("to_uri")),
            ("WARC-Refers-To-Date", F.col("to_date")), ("WARC-Profile", F.lit(PROFILE))]
    response = _record("response", common, F.concat(_http(F.octet_length("payload")), F.decode("payload", "UTF-8")))
    revisit = _record("revisit", common + back, F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{END}"))
    return _write(records.select(F.when(F.col("to").isNull(), response).otherwise(revisit).alias("value")), target)


def archive_table(spark: SparkSession, path: str) -> DataFrame:
    """What an archive says of each page: revisits get the payload length and
    the page id of the response they refer to."""
    heads = written(read_archive(spark, path).drop("payload"), "warc-read")
    targets = heads.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("to_page"),
        F.col("payload_bytes").alias("to_bytes"))
    asked = heads.filter("record_type = 'revisit'").join(targets, "refers_to_record", "left").select(
        "page_id", F.col("to_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("to_page").alias("refers_to"))
    plain = heads.filter("record_type <> 'revisit'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(asked)


def deduplicated_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as an archive, resolve its revisits into a second one
    and read that back."""
    spark = pages.sparkSession
    raw = write_archive(pages, scratch_path(spark, "warc-raw"))
    clean = resolve_revisits(spark, raw, scratch_path(spark, "warc-clean"), min_bytes)
    return archive_table(spark, clean)
