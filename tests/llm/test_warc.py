"""Archives: exact round trip, revisits against a plain grouping."""
import gzip
import hashlib
from pathlib import Path

import pytest

from poolwise.llm import warc
from poolwise.session import scratch_path

BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (9, "http://a/9", BIG), (3, "u\r\nX-Evil: 1", "small"),
        (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "http://a/6", ""), (None, "http://a/n", "x" * 1000),
        (None, "http://a/n", "x" * 1000), (7, "http://a/7", "x" * 1000), (8, "http://a/8", "\r\n\r\n" * 400),
        (10, "http://a/10", "\r\n\r\n" * 400 + "\r\n"), (11, "http://a/11", "é" * 499 + "z"), (12, "http://a/12", "é" * 499 + "z")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, payload string")


def test_round_trip(spark, pages):
    path = warc.write_archive(pages, scratch_path(spark, "w"))
    got = sorted((str(r.page_id), bytes(r.payload), r.payload_bytes, r.payload_digest)
                 for r in warc.read_archive(spark, path, with_payload=True).collect())
    raw = [(str(i), (h or "").encode()) for i, _, h in ROWS]
    assert got == sorted((i, b, len(b), hashlib.sha1(b).hexdigest()) for i, b in raw)


def test_revisits(spark, pages):
    rows = warc.deduplicated_pages(pages).collect()
    assert len(rows) == len(ROWS)
    big = hashlib.sha1(BIG.encode()).hexdigest()
    group = sorted((r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_digest == big)
    assert [x[0] for x in group] == [1, 2, 9, 9] and sorted(x[1] for x in group) == ["response"] + ["revisit"] * 3
    assert {x[2] for x in group if x[1] == "revisit"} == {9}
    assert all(r.payload_bytes == len(BIG.encode()) for r in rows if r.payload_digest == big)
    xs = {(r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_bytes == 1000}
    assert xs == {(None, "revisit", 7), (7, "response", None)}
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 1000)


def test_existing_revisits_follow(spark, pages):
    first = warc.resolve_revisits(spark, warc.write_archive(pages, scratch_path(spark, "w")), scratch_path(spark, "w"))
    again = warc.resolve_revisits(spark, first, scratch_path(spark, "w"), date="2025-01-01T00:00:00Z")
    a, b = (sorted(map(str, warc.archive_table(spark, p).collect())) for p in (first, again))
    assert a == b
    ids = [r.record_id for r in warc.read_archive(spark, again).collect()]
    assert len(ids) == len(set(ids)) == len(ROWS)


def test_files_are_gzip_warc(spark, pages):
    path = warc.write_archive(pages, scratch_path(spark, "w"))
    files = list(Path(path.removeprefix("file:")).glob("part-*.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nX-Evil" not in text


def test_damage_is_noticed():
    record = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9", b"head", b"x"]
    assert [b for _, b in warc._records(iter(record))] == [b"head\r\n\r\nx"]
    for bad in (record[:2], [b"junk"], [record[0], b"head", b"xyz", b"more"], record + [b"WARC/1.1"]):
        with pytest.raises((ValueError, KeyError)):
            list(warc._records(iter(bad)))


def test_payloads_that_end_in_parts_of_the_terminator(spark):
    ends = ["a\r", "a\r\n", "a\r\n\r", "a\r\n\r\n", "\n", "\r\n", "\r\n\r\n\r\n", ""]
    rows = [(i, "http://x/", e) for i, e in enumerate(ends * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = warc.write_archive(df, scratch_path(spark, "w"))
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archive(spark, path, with_payload=True).collect()}
    assert got == {i: e for i, _, e in rows}


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.deduplicated_pages(empty).collect() == []
