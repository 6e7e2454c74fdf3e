"""Sharding: every row once, near-equal bytes, gapless slots, hot texts split."""
import zlib
from collections import Counter, defaultdict

import pytest

from poolwise.llm import sharding


def check(rows, texts, shards, slack):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    held, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(held.values()) / shards
    assert all(abs(held[s] - mean) <= slack for s in range(shards))


@pytest.mark.parametrize("max_rows", [40, 500_000])
def test_hot_text_and_subdivision(spark, max_rows):
    texts = [(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(900)]
    texts += [(None, None), (None, "x"), (5, "z" * 2000)] + [(1, "twice")] * 120
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, shard int")
    rows = sharding.shard_by_bytes(df, shards=6, ranges_per_shard=2, oversample=8, max_range_rows=max_rows, ways=4).collect()
    check(rows, texts, 6, 2010)


def test_empty_and_few(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_bytes(df).collect() == []
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert len(sharding.shard_by_bytes(df).collect()) == 2


def test_whole_query(spark):
    from poolwise.llm.queries import op5_sharding

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op5_sharding(spark, sf).collect(), texts, 24, max(len((t or "").encode()) + 8 for _, t in texts))
