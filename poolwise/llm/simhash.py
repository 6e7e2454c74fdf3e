"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints that differ in at most two bits
differ in at most one bit in one of their two 32-bit halves: in the low half,
or, if that differs in both, in no bit of the high half. So each distinct
fingerprint is indexed under 33 keys: its low half with each one bit wild, and
its high half (one variant stands for all, as it must be equal). Fingerprints
under the same key are candidates and are verified by their bit distance.

The keys are shuffled once and sorted, so equal keys meet in a stream of narrow
rows. Of a pair's common keys one speaks for it - the wild bit where the low
halves differ, the first bit where they are equal - so each link comes once.

Equal texts and equal fingerprints are reduced before anything is joined, so
copies cost nothing. Keys that many fingerprints share are never expanded
into pairs: beyond ``max_bucket`` members a key is split exactly by wildcards
in the *other* half (one wild bit there where this half may differ, two wild
bits where this half is equal). Such a sub-key fixes all but two bits, so at
most four distinct fingerprints share it, and all of them are linked.

The links' connected components come from alternating large-star and
small-star steps, each written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; fewer words than a shingle give one shingle of all words; a null
doc_id never becomes a component's id unless all of its rows have none;
repeated rows give repeated results (the filter keeps one of them); other
columns are ignored or, in the filter, passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, with_row_key, written


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i:i + shingle]) for i in range(n)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """A narrow row per row of ``docs``: doc_id, ``_tag`` (a hash of the text,
    which with the id says which document it is), ``_rid`` and ``_fp``; written
    once."""
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag(), "text"))
    schema = "doc_id long, _tag long, _rid long, _fp long"

    def hashed(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "_tag", "_rid")], pa.array(fps, pa.int64())],
                                             names=["doc_id", "_tag", "_rid", "_fp"])

    return written(keyed.mapInArrow(hashed, schema), "fingerprints")


def _tag():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tag")


def _variants(fps: DataFrame) -> DataFrame:
    """33 rows a fingerprint: key = half (1 bit), wild bit (5 bits), the half
    with that bit cleared (32 bits)."""
    return (fps.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("i"))
            .select("_fp", F.expr("(shiftleft(cast(i as bigint), 32)) | (shiftrightunsigned(_fp, 32 * (i div 32)) "
                                  "& 4294967295L & ~shiftleft(1L, i % 32))").alias("key")))


def _bit_distance(a: str, b: str):
    return F.expr(f"bit_count({a} ^ {b})")


def _speaking_key(differing: np.ndarray) -> np.ndarray:
    """Which of a pair's common keys speaks for it, by its differing bits: its
    number (half and wild bit)."""
    low = differing & np.uint64(0xFFFFFFFF)
    count = np.bitwise_count(low)
    bit = np.bitwise_count(low - np.uint64(1))  # position of a single bit
    return np.where(count == 0, 0, np.where(count == 1, bit, 32)).astype(np.int64)


def _pairs(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links that the keys of a sorted run speak for; keys are of bounded
    size, so row ``i`` is compared with the rows right behind it."""
    a, b = [], []
    step, at = 1, np.arange(len(keys))
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        differing = (fps[at] ^ fps[at + step]).view(np.uint64)
        near = (np.bitwise_count(differing) <= max_bits) & (_speaking_key(differing) == keys[at] >> 32)
        a.append(fps[at[near]])
        b.append(fps[at[near] + step])
        step += 1
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _met(variants: DataFrame, max_bits: int, max_bucket: int) -> DataFrame:
    """Rows (large, a, b) of sorted keys: links of keys with at most
    ``max_bucket`` members, and, marked ``large``, the members (key, _fp) of
    the others. A task holds one batch and at most one small key's rows."""
    def run(batches):
        held_k, held_f, passing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None

        def out(links, members):
            a, b = (np.concatenate(x) for x in zip(links, members))
            if len(a):
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) >= len(links[0])), pa.array(a), pa.array(b)], names=["large", "a", "b"])

        def settle(k, f):
            """Whole keys: pairs of the small ones, members of the large ones."""
            ends = np.flatnonzero(np.append(k[1:] != k[:-1], True)) if len(k) else np.zeros(0, dtype=np.int64)
            sizes = np.diff(ends, prepend=-1)
            big = np.repeat(sizes > max_bucket, sizes)
            return out(_pairs(k[~big], f[~big], max_bits), (k[big], f[big]))

        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy()])
            f = np.concatenate([held_f, batch.column("_fp").to_numpy()])
            if not len(k):
                continue
            if passing is not None:  # more of a key known to be large
                n = int(np.searchsorted(k, passing, side="right"))
                if n:
                    yield out((k[:0], k[:0]), (k[:n], f[:n]))
                k, f = k[n:], f[n:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                passing = None
            last = int(np.searchsorted(k, k[-1], side="left"))  # the last key may go on
            got = settle(k[:last], f[:last])
            if got is not None:
                yield got
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > max_bucket:
                passing = held_k[0]
                yield out((held_k[:0], held_k[:0]), (held_k, held_f))
                held_k, held_f = held_k[:0], held_f[:0]
        got = settle(held_k, held_f)
        if got is not None:
            yield got

    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(run, "large boolean, a long, b long")


def _links_of_large(members: DataFrame, max_bits: int) -> DataFrame:
    """Links within keys of any number of members: sub-keys that fix all but
    two bits."""
    m = members.select("_fp", "key", F.expr("cast(shiftrightunsigned(key, 32) as int)").alias("i")).select(
        "_fp", "key", "i",
        F.expr("shiftrightunsigned(_fp, 32 * (1 - i div 32)) & 4294967295L").alias("other"),
        F.expr("shiftrightunsigned(_fp, 32 * (i div 32)) & 4294967295L").alias("own"))
    one = m.select("_fp", "key", "other", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("v")).select(
        "_fp", "key", F.expr("shiftleft(cast(v as bigint), 32) | (other & ~shiftleft(1L, v))").alias("sub"))
    pairs = F.expr("flatten(transform(sequence(1, 31), x -> transform(sequence(0, x - 1), y -> x * 32 + y)))")
    two = (m.filter(F.col("i") % 32 == 0).select("_fp", "i", "own", "other", F.explode(pairs).alias("c"))
           .select("_fp", F.expr("-1 - (own | shiftleft(cast(i div 32 as bigint), 32))").alias("key"),
                   F.expr("shiftleft(cast(c as bigint), 32) | (other & ~shiftleft(1L, c div 32) & ~shiftleft(1L, c % 32))")
                   .alias("sub")))
    groups = (one.unionByName(two).groupBy("key", "sub")
              .agg(F.min("_fp").alias("a"), F.max("_fp").alias("z"), F.collect_list("_fp").alias("fps"))
              .filter("a <> z"))
    out = groups.select("a", F.explode("fps").alias("b")).filter("a <> b")
    return out.filter(_bit_distance("a", "b") <= max_bits)


def links(fps: DataFrame, max_bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """Distinct links (a, b) among the distinct fingerprints ``_fp``, enough
    to connect every pair at ``max_bits`` or fewer differing bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two halves with one wild bit each cover distances 0 to 2")
    met = written(_met(_variants(fps), max_bits, max_bucket), "simhash-met")
    small = met.filter(~F.col("large")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = _links_of_large(met.filter("large").select(F.col("a").alias("key"), F.col("b").alias("_fp")), max_bits)
    out = written(small.unionByName(large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "links")
    drop_written(met)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (a, b), a <> b; the label is
    the smallest node that can be reached. Large-star / small-star."""
    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    def star(pairs, larger_only):
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(low, "a")
        if larger_only:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(low.select("a", F.col("m").alias("b"))))

    seen = state(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(star(both, True).filter("a <> b").distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(star(down, False).filter("a <> b").distinct(), "small-star")
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots), "components")


def near_duplicates(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """``rows`` of :func:`fingerprints` with ``component_id``, the smallest
    doc_id reachable, and ``_keep_rid``, the row that stays for the group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), "_rid"))
    fps = written(rows.groupBy("_fp").agg(first.alias("first")), "distinct-fingerprints")
    labels = components(links(fps.select("_fp"), max_bits))
    labelled = fps.join(labels.withColumnRenamed("node", "_fp"), "_fp", "left").select(
        "_fp", "first", F.coalesce("label", "_fp").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    classes = labelled.join(heads, "label").select("_fp", F.col("head.doc_id").alias("component_id"),
                                                   F.col("head._rid").alias("_keep_rid"))
    return rows.join(written(classes, "simhash-classes"), "_fp")


def simhash_table(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    rows = near_duplicates(fingerprints(docs, shingle), max_bits)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies. Texts are not copied:
    the narrow table says which (doc_id, text) stay, and of rows that repeat
    one of those the largest stays."""
    ids = near_duplicates(fingerprints(docs, shingle), max_bits)
    firsts = ids.filter("_rid = _keep_rid").select(F.col("_rid").alias("_keep_rid"), F.col("doc_id").alias("_kd"), F.col("_tag").alias("_kt"))
    other = ids.filter("_rid <> _keep_rid").join(firsts, "_keep_rid").select(
        "doc_id", "_tag", (F.col("doc_id").eqNullSafe(F.col("_kd")) & (F.col("_tag") == F.col("_kt"))).alias("same")).distinct()
    other = written(other.select(F.col("doc_id").alias("_d"), F.col("_tag").alias("_g"), "same"), "near-copies")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_tag") == F.col("_g"))
    rows = docs.select("doc_id", _tag(), F.struct("*").alias("_row"))
    left = rows.join(other.filter("not same"), match, "left_anti")
    repeated = other.filter("same")
    if repeated.isEmpty():
        return left.select("_row.*")
    alone = left.join(repeated, match, "left_anti").select("_row")
    first = left.join(repeated, match, "left_semi").groupBy("doc_id", "_tag").agg(F.max("_row").alias("_row"))
    return alone.unionByName(first.select("_row")).select("_row.*")
