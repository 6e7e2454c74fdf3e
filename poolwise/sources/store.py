"""Feature stores laid out by key.

A store is two tables. The rows (key, pos, vec…) are bucketed by (key, pos) and
sorted by them: a fetch joins on these two, so the rows that hold vectors never
move, only the narrow list of wanted positions is sent to their buckets; and a
key with a third of all rows is spread over every bucket. The lengths (key, n)
are taken once, when the store is written, together with the proof that every
sequence has the positions 0 to n - 1, so readers scan no vectors to learn them.

Tables are external (their files lie where the caller says), so another session
opens them with :func:`open_store`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import proved_lengths, sequence_proof


@dataclass(frozen=True)
class BucketedStore:
    """Names of a store's tables in the session's catalog."""
    rows_table: str
    lengths_table: str
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.rows_table)

    def lengths(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.lengths_table)


def _named(name: str, buckets: int) -> BucketedStore:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a table name: {name!r}")
    return BucketedStore(name, f"{name}_lengths", buckets)


def write_store(df: DataFrame, name: str, path: str, buckets: int | None = None, key: str = "key", pos: str = "pos",
                on_bad: str = "fail") -> BucketedStore:
    """Write ``df`` (key, pos int, values…) as the store ``name`` under
    ``path``. A sequence with gaps or repeats, or rows without a key, raise
    before anything is written (``'fail'``) or are left out (``'quarantine'``)."""
    if on_bad not in ("fail", "quarantine"):
        raise ValueError(on_bad)
    spark = df.sparkSession
    store = _named(name, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn(pos, F.col(pos).cast("int"))
    if on_bad == "quarantine":
        sound = sequence_proof(rows.filter(F.col(key).isNotNull()), key, pos).filter("dense").select(key)
        rows = rows.join(sound, key, "left_semi")
    for row in rows.filter(F.col(key).isNull()).limit(1).collect():
        raise ValueError(f"a row without a key at position {row[pos]}")
    lengths = proved_lengths(rows, key, pos)
    (lengths.repartition(store.buckets, key).write.mode("overwrite").bucketBy(store.buckets, key).sortBy(key)
     .option("path", f"{path}/lengths").saveAsTable(store.lengths_table))
    # one task a bucket, so a bucket is one sorted file
    (rows.repartition(store.buckets, key, pos).write.mode("overwrite").bucketBy(store.buckets, key, pos).sortBy(key, pos)
     .option("path", f"{path}/rows").saveAsTable(store.rows_table))
    return store


def open_store(spark: SparkSession, name: str, path: str, buckets: int, key: str = "key", pos: str = "pos") -> BucketedStore:
    """Register a store that another session has written."""
    store = _named(name, buckets)
    for table, folder, columns in ((store.rows_table, "rows", f"{key}, {pos}"), (store.lengths_table, "lengths", key)):
        schema = spark.read.parquet(f"{path}/{folder}").schema
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}/{folder}'")
    return store


def drop_store(spark: SparkSession, store: BucketedStore) -> None:
    """Forget the tables; the files stay."""
    for table in (store.rows_table, store.lengths_table):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
