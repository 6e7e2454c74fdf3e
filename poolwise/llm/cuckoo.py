"""Exact de-duplication with a cuckoo-filter index.

The index is a table in the shared folder with three kinds of rows, spread
over buckets by digest: the *keys* of a bucket (digest, length, the row that
stays, how many live rows have the digest), its *cuckoo filter* (16-bit
fingerprints, four slots a cell, two cells a fingerprint) and nothing else.
``insert`` and ``delete`` work bucket by bucket in parallel and write the next
version of the table; a filter that overflows is doubled and filled again
from the keys stored beside it. The filter answers most misses; every hit is
verified against the stored keys of its bucket, so results are exact.

Copies are counted before the shuffle: rows of one digest are first reduced
per input partition, so a digest that a third of all rows share reaches its
bucket as at most one row per partition.

Defined cases: a null text counts as empty; equal (doc_id, text) rows are
copies of one another and exactly one of them stays; a null doc_id sorts
after all others, so it stays only where no row has an id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_row_key, written

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Cuckoo filter over 64-bit hashes: ``add`` is False on overflow."""

    def __init__(self, cells: int = 64, data: bytes | None = None):
        self.cells = cells
        if data is None:
            self.table = np.zeros((cells, SLOTS), dtype=np.uint16)
        else:
            self.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
            self.cells = len(self.table)
        self.kicks = 0

    def _place(self, h: int) -> tuple[int, int, int]:
        fp = (h & 0xFFFF) or 1
        first = (h >> 16) & (self.cells - 1)
        return fp, first, self._other(first, fp)

    def _other(self, cell: int, fp: int) -> int:
        return cell ^ ((fp * 0x5BD1E995 >> 7) & (self.cells - 1))

    def has(self, h: int) -> bool:
        fp, a, b = self._place(h)
        return fp in self.table[a] or fp in self.table[b]

    def add(self, h: int) -> bool:
        fp, a, b = self._place(h)
        for cell in (a, b):
            free = np.flatnonzero(self.table[cell] == 0)
            if len(free):
                self.table[cell, free[0]] = fp
                return True
        cell, undo = b, []
        for _ in range(MAX_KICKS):
            self.kicks += 1
            slot = self.kicks % SLOTS
            undo.append((cell, slot))
            fp, self.table[cell, slot] = int(self.table[cell, slot]), fp
            cell = self._other(cell, fp)
            free = np.flatnonzero(self.table[cell] == 0)
            if len(free):
                self.table[cell, free[0]] = fp
                return True
        for cell, slot in reversed(undo):  # a failed insertion must not lose the last one kicked out
            fp, self.table[cell, slot] = int(self.table[cell, slot]), fp
        return False

    def remove(self, h: int) -> bool:
        fp, a, b = self._place(h)
        for cell in (a, b):
            at = np.flatnonzero(self.table[cell] == fp)
            if len(at):
                self.table[cell, at[0]] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def holding(cls, hashes: list[int], cells: int) -> "CuckooFilter":
        """A filter of at least ``cells`` cells with all ``hashes`` in it."""
        while True:
            out = cls(cells)
            if all(out.add(h) for h in hashes):
                return out
            cells *= 2


def _hash64(digest: str) -> int:
    return int(digest[16:32], 16)


STATE = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("keep_id", T.LongType()), T.StructField("keep_rid", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("filter", T.BinaryType()),
    T.StructField("resized", T.IntegerType()),
])


def _order(doc_id, rid) -> tuple:
    return (pd.isna(doc_id), 0 if pd.isna(doc_id) else int(doc_id), int(rid))


def _apply(pdf: pd.DataFrame, cells: int) -> pd.DataFrame:
    """One bucket: stored keys and filter, then the batch's rows (``add`` or
    ``del``) in digest order. Returns the bucket's next state."""
    bucket = int(pdf["bucket"].iloc[0])
    keys: dict[str, list] = {}
    filt, resized = None, 0
    for r in pdf[pdf["kind"] == "key"].itertuples():
        keys[r.digest] = [int(r.n_bytes), _order(r.keep_id, r.keep_rid), int(r.n)]
    for r in pdf[pdf["kind"] == "filter"].itertuples():
        filt, resized = CuckooFilter(data=r.filter), int(r.resized)
    if filt is None:
        filt = CuckooFilter(cells)
    for r in pdf[pdf["kind"] == "add"].sort_values(["digest", "keep_rid"]).itertuples():
        h = _hash64(r.digest)
        if filt.has(h) and r.digest in keys and keys[r.digest][0] == r.n_bytes:  # a verified hit
            key = keys[r.digest]
            key[1], key[2] = min(key[1], _order(r.keep_id, r.keep_rid)), key[2] + int(r.n)
            continue
        keys[r.digest] = [int(r.n_bytes), _order(r.keep_id, r.keep_rid), int(r.n)]
        if not filt.add(h):
            filt = CuckooFilter.holding([_hash64(k) for k in keys], filt.cells * 2)
            resized += 1
    for r in pdf[pdf["kind"] == "del"].itertuples():
        h = _hash64(r.digest)
        if filt.has(h) and r.digest in keys:
            keys[r.digest][2] -= int(r.n)
            if keys[r.digest][2] <= 0:
                filt.remove(h)
                del keys[r.digest]
    rows = [(bucket, "key", d, nb, None if o[0] else o[1], o[2], n, None, None) for d, (nb, o, n) in keys.items()]
    rows.append((bucket, "filter", None, None, None, None, len(keys), filt.to_bytes(), resized))
    out = pd.DataFrame(rows, columns=STATE.names)
    for c in ("n_bytes", "keep_id", "keep_rid", "n", "resized"):
        out[c] = out[c].astype("Int64")
    return out


def _probe(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of the bucket's asked digests are live."""
    keys = set(pdf.loc[pdf["kind"] == "key", "digest"])
    filt = next((CuckooFilter(data=b) for b in pdf.loc[pdf["kind"] == "filter", "filter"]), CuckooFilter())
    asked = pdf.loc[pdf["kind"] == "ask", "digest"]
    return pd.DataFrame({"digest": asked, "live": [filt.has(_hash64(d)) and d in keys for d in asked]})


class CuckooIndex:
    """A versioned index of live digests. ``buckets`` should keep a bucket's
    keys in the tens of thousands; it is fixed at creation."""

    def __init__(self, spark: SparkSession, buckets: int = 64, cells: int = 256):
        self.spark, self.buckets, self.cells = spark, buckets, cells
        self.state = spark.createDataFrame([], STATE)

    def _bucket(self) -> Column:
        return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def _rows(self, df: DataFrame, kind: str) -> DataFrame:
        blank = {f.name: F.lit(None).cast(f.dataType) for f in STATE}
        blank |= {c: F.col(c) for c in df.columns if c in STATE.names}
        blank |= {"bucket": self._bucket(), "kind": F.lit(kind)}
        return df.select(*[blank[f.name].cast(f.dataType).alias(f.name) for f in STATE])

    def _next(self, rows: DataFrame) -> None:
        cells = self.cells
        step = self.state.unionByName(rows).groupBy("bucket").applyInPandas(lambda pdf: _apply(pdf, cells), STATE)
        self.state = written(step, "cuckoo")

    def insert(self, digests: DataFrame) -> None:
        """Rows (digest, n_bytes, doc_id, _rid), repeats included."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid"))
        partial = (digests.withColumn("_part", F.spark_partition_id()).groupBy("digest", "n_bytes", "_part")
                   .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
                   .select("digest", "n_bytes", F.col("first.doc_id").alias("keep_id"),
                           F.col("first._rid").alias("keep_rid"), "n"))
        self._next(self._rows(partial, "add"))

    def delete(self, digests: DataFrame) -> None:
        """Take one live row of each given digest out (repeats take more); a
        digest with none left is forgotten, in the filter too."""
        self._next(self._rows(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "del"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, live) for each distinct given digest."""
        rows = self.state.unionByName(self._rows(digests.select("digest").distinct(), "ask"))
        return rows.groupBy("bucket").applyInPandas(_probe, "digest string, live boolean")

    def keys(self) -> DataFrame:
        return self.state.filter(F.col("kind") == "key").select("digest", "keep_id", "keep_rid", "n")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, _rid, digest, n_bytes) of the normalised texts, written once."""
    text = F.encode(normalised(F.col("text")), "UTF-8")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = keyed.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return written(with_row_key(keyed), "digests")


def exact_duplicates(docs: DataFrame, keys_per_bucket: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: the row that stays for its text, how many
    rows have the text, whether this is the one, and the text's digest."""
    rows = digests_of(docs)
    index = CuckooIndex(docs.sparkSession, buckets=max(64, -(-rows.count() // keys_per_bucket)))
    index.insert(rows)
    return (rows.join(index.keys(), "digest")
            .select("doc_id", "keep_id", F.col("n").alias("group_size"),
                    (F.col("_rid") == F.col("keep_rid")).alias("kept"), F.col("digest").alias("text_sha256")))
