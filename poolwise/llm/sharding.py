"""Sharding by sampled splitters.

Records are put in the order of a key: the hash of the text, then the id, so
that equal texts lie side by side. A size-weighted sample of the keys (a
record's chance to be drawn grows with its bytes) gives quantile boundaries,
and the records are range-partitioned by them. A range with more records than
allowed is sampled and split again until none is overfull; the key goes on to
the id, so a text that a third of all rows share is split like any other
range. Running byte and row counts inside the ranges, plus the ranges'
totals, give each record its exact place in the whole order; shard s takes the
s-th equal share of the bytes, so shards differ by one record's size at most.

Only DataFrame functions are used. Texts are read once, for their length and
hashes; everything after works on the narrow rows.

Law ``bytes``: sizes near equal (a table with fewer records than shards leaves
shards empty). Defined cases: a null text has no bytes and the checksum of the
empty text; null ids sort first; repeated rows are told apart by a row key;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_row_key, written


def _sortable(c: Column) -> Column:
    """A bigint as 16 hex digits in its signed order; null first."""
    return F.coalesce(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))


def _drawn(size: Column, expected: int, total: int) -> Column:
    """Poisson sample with chance proportional to size; repeatable."""
    u = (F.shiftrightunsigned(F.xxhash64("key", F.lit(11)), 11).cast("double")) / float(1 << 53)
    return u < size * F.lit(expected / max(total, 1))


def _quantiles(keys: list[str], parts: int) -> list[str]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _range_of(key: Column, bounds: Sequence[str]) -> Column:
    """Number of bounds at or below the key, as a balanced tree of tests."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(bounds))


def _subdivided(rows: DataFrame, max_rows: int, ways: int, oversample: int, max_depth: int) -> DataFrame:
    """Split every range with over ``max_rows`` rows into up to ``ways``."""
    for _ in range(max_depth):
        totals = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        over = written(totals.filter(F.col("n") > max_rows), "overfull")
        if over.isEmpty():
            break
        u = (F.shiftrightunsigned(F.xxhash64("key", F.lit(13)), 11).cast("double")) / float(1 << 53)
        picked = (rows.join(over, "range").filter(u < F.col("size") * (ways * oversample) / F.col("bytes"))
                  .groupBy("range").agg(F.sort_array(F.collect_list("key")).alias("keys")))
        bounds = written(picked.select("range", F.expr(
            f"array_distinct(transform(sequence(1, {ways - 1}), i -> keys[cast(floor(size(keys) * i / {ways}) as int)]))"
        ).alias("bounds")), "sub-splitters")
        rows = written(rows.join(bounds, "range", "left").select(
            "doc_id", "size", "text_crc32", "key",
            F.concat("range", F.lit("."), F.lpad(F.coalesce(F.expr(
                "size(filter(bounds, b -> b <= key))"), F.lit(0)).cast("string"), 4, "0")).alias("range")), "ranges")
    return rows


def shard_by_bytes(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 8, oversample: int = 24,
                   max_range_rows: int = 500_000, ways: int = 64, max_depth: int = 8) -> DataFrame:
    """Assign every row of ``docs`` to a shard: doc_id, size, text_crc32, law,
    shard, slot, grown_shard (null: the law says nothing about growth).

    The first sample has about ``shards * ranges_per_shard * oversample`` keys
    whatever the input; a later one about ``ways * oversample`` per overfull
    range."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_row_key(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.encode(text, "UTF-8")).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    rows = written(rows.select("doc_id", "size", "text_crc32",
                               F.concat(_sortable(F.col("h")), _sortable(F.col("doc_id")), F.lit("/"),
                                        _sortable(F.col("_rid"))).alias("key")), "shard-keys")
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    parts = shards * ranges_per_shard
    sample = [r["key"] for r in rows.filter(_drawn(F.col("size"), parts * oversample, total)).select("key").collect()]
    first = _range_of(F.col("key"), _quantiles(sample, parts))
    rows = rows.withColumn("range", F.lpad(first.cast("string"), 6, "0"))
    rows = _subdivided(rows, max_range_rows, ways, oversample, max_depth)

    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = written(totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
                                    F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before")), "offsets")
    placed = (rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("no", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
              .join(offsets, "range")
              .select("doc_id", "size", "text_crc32", (F.col("no") + F.col("rows_before")).alias("no"),
                      F.expr(f"cast(least({shards - 1}, floor((cast(at + bytes_before as double) + size / 2.0) "
                             f"* {shards} / {float(max(total, 1))})) as int)").alias("shard")))
    placed = written(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("no").alias("start"))  # at most one row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("no") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
