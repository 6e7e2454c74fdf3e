"""Frame-sequence operators in long form ``(key, pos, value…)``.

Sequences stay one row per position: a clip selects rows with an equi join on
the source key plus a range predicate, fixed lengths are row filters on
``pos`` arithmetic, and padding rows are generated and unioned – nothing
collects a sequence into an array, so no task holds a whole video's vectors.
Positions of the output are computed from lengths (clip offsets are running
sums over an item's few clips), never with a window over frame rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clip_fields
from ..functions.vectors import cosine

FRAME_LEN = 83   # fixed value: frames and motion features per item
AUDIO_LEN = 50   # fixed value: audio frames per item


def parse_clips(clips: DataFrame, clip_col: str = "clip") -> DataFrame:
    """Adds src, s, e and ``valid`` (all three parsed, 0 <= s)."""
    f = clip_fields(clip_col)
    out = clips.withColumn("src", f["src"]).withColumn("s", f["s"]).withColumn("e", f["e"])
    return out.withColumn("valid", F.col("s").isNotNull() & F.col("e").isNotNull()
                          & (F.col("s") >= 0) & (F.col("e") >= 0) & (F.length("src") > 0))


def sequence_lengths(seq: DataFrame, key: str = "key") -> DataFrame:
    """key, n. A partial + final count: a hot key is pre-aggregated per map
    task before the shuffle."""
    return seq.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def sequence_proof(seq: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """key, n, dense: the row count, and whether the positions are exactly 0 to
    n - 1. One aggregate on (key, position), then on the key, so a hot key is
    spread over its positions."""
    p = F.col(pos)
    return seq.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count_distinct(p).alias("_d")) \
        .select(key, "n", F.coalesce((F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_d") == F.col("n")), F.lit(False)).alias("dense"))


def dense_lengths(proof: DataFrame, key: str = "key") -> DataFrame:
    """key, n of the sequences that a :func:`sequence_proof` finds dense."""
    return proof.filter(F.col("dense") & F.col(key).isNotNull()).select(key, "n")


def lengths_or_fail(proof: DataFrame, key: str = "key") -> DataFrame:
    """key, n of all sequences of a :func:`sequence_proof`; one that is not
    dense raises when the result is computed."""
    what = F.concat(F.lit("positions with gaps or repeats in the sequence of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return proof.select(key, F.when(F.col("dense"), F.col("n")).otherwise(F.raise_error(what).cast("long")).alias("n"))


def without_bad(seq: DataFrame, proof: DataFrame, key: str = "key") -> DataFrame:
    """The rows of sequences that a :func:`sequence_proof` finds dense (a null
    key has no sequence). The keys to leave out are joined, not those to keep:
    they are few as a rule, and then no task sorts the rows for it."""
    return seq.filter(F.col(key).isNotNull()).join(proof.filter(~F.col("dense")).select(key), key, "left_anti")


def proved_lengths(seq: DataFrame, key: str = "key", pos: str = "pos", on_bad: str = "fail") -> DataFrame:
    """:func:`sequence_lengths` of sequences whose positions are proved to be 0
    to n - 1. A gap or a repeat raises when the result is computed (``'fail'``)
    or leaves the key out (``'quarantine'``)."""
    proof = sequence_proof(seq, key, pos)
    if on_bad == "quarantine":
        return proof.filter("dense").select(key, "n")
    if on_bad != "fail":
        raise ValueError(on_bad)
    return lengths_or_fail(proof, key)


#: Reasons of :func:`sequence_faults`.
FAULTS = ("repeat", "gap", "no vector", "width", "not a number")


def sequence_faults(seq: DataFrame, key: str = "key", pos: str = "pos", vec: str = "vec", width: int | None = None) -> DataFrame:
    """key, reason for every sequence that can't be used: positions that
    repeat, or are not 0 to the last; a row without a vector; vectors of other
    than one width (or not of ``width``); entries that are not finite. Several
    reasons give several rows. One pass: rows are reduced to one per (key,
    position) first."""
    x = F.col(vec)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = seq.select(key, F.col(pos).alias("_p"), x.isNull().cast("int").alias("_null"), F.when(x.isNotNull(), F.size(x)).alias("_w"),
                      F.coalesce((~finite).cast("int"), F.lit(0)).alias("_nan"))
    at = rows.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_n"), F.max("_null").alias("_null"), F.min("_w").alias("_lo"),
                                     F.max("_w").alias("_hi"), F.max("_nan").alias("_nan"))
    each = at.groupBy(key).agg(F.max("_n").alias("_n"), F.count("_p").alias("_d"), F.count(F.lit(1)).alias("_rows"), F.min("_p").alias("_first"),
                               F.max("_p").alias("_last"), F.max("_null").alias("_null"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
                               F.max("_nan").alias("_nan"))
    dense = (F.col("_first") == 0) & (F.col("_last") == F.col("_d") - 1) & (F.col("_rows") == F.col("_d"))
    mixed = (F.col("_lo") != F.col("_hi")) if width is None else (F.col("_lo") != width) | (F.col("_hi") != width)
    bad = (F.col("_n") > 1, ~F.coalesce(dense, F.lit(False)), F.col("_null") > 0, F.coalesce(mixed, F.lit(False)), F.col("_nan") > 0)
    found = F.filter(F.array(*[F.when(b, F.lit(name)) for b, name in zip(bad, FAULTS)]), lambda r: r.isNotNull())
    return each.select(key, F.explode(found).alias("reason"))


def sound_sequences(seq: DataFrame, key: str = "key", pos: str = "pos", vec: str = "vec", width: int | None = None) -> DataFrame:
    """The rows of sequences without faults (a null key has no sequence)."""
    bad = sequence_faults(seq, key, pos, vec, width).select(key).distinct()
    return seq.filter(F.col(key).isNotNull()).join(bad, key, "left_anti")


def bad_clips(clips: DataFrame, frames: DataFrame, item_col: str = "item_id",
              clip_col: str = "clip", key: str = "key") -> DataFrame:
    """item, clip, reason (``malformed`` / ``no frames``) for every clip that
    cannot be cut out of its source."""
    parsed = parse_clips(clips, clip_col)
    have = frames.select(F.col(key).cast("string").alias("src")).distinct()
    absent = parsed.filter("valid").join(have, "src", "left_anti").select(item_col, clip_col, F.lit("no frames").alias("reason"))
    return parsed.filter(~F.col("valid")).select(item_col, clip_col, F.lit("malformed").alias("reason")).unionByName(absent)


def clip_lengths(clips: DataFrame, frames: DataFrame, item_col: str = "item_id",
                 order_col: str = "material_pos", clip_col: str = "clip",
                 key: str = "key", on_bad: str = "fail", pos: str = "pos", lengths: DataFrame | None = None) -> DataFrame:
    """Per clip: src, s, e, n (frames of the source, whose positions must be 0
    to n - 1: see :func:`proved_lengths`), len = rows the clip contributes (``min(n, e) + 1 - min(n, s)`` clamped at 0) and offset = the
    clip's first output position inside its item.

    A malformed clip, or one whose source has no frames, never shortens its
    item silently: ``on_bad='fail'`` raises, ``'quarantine'`` leaves the whole
    item out, ``'checked'`` is for callers that have looked already."""
    if on_bad not in ("fail", "quarantine", "checked"):
        raise ValueError(on_bad)
    if lengths is None:
        lengths = proved_lengths(frames, key, pos, "quarantine" if on_bad == "quarantine" else "fail")
    lens = lengths.withColumnRenamed(key, "src")
    j = parse_clips(clips, clip_col).join(lens, "src", "left")
    if on_bad != "checked":
        ok = F.col("valid") & F.col("n").isNotNull()
        if on_bad == "fail":
            for row in j.filter(~ok).select(item_col, clip_col).limit(1).collect():
                raise ValueError(f"clip {row[clip_col]!r} of item {row[item_col]!r} has no frames")
        else:
            j = j.join(j.filter(~ok).select(item_col).distinct(), item_col, "left_anti")
    j = j.fillna(0, ["n"])
    j = j.withColumn("len", F.greatest(F.lit(0), F.least("n", F.col("e") + 1) - F.least("n", "s")))
    w = Window.partitionBy(item_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn("clip_offset", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("long"))


#: Positions per bucket of the clip join.
CLIP_BUCKET = 64


def clip_frames(clips: DataFrame, frames: DataFrame, item_col: str = "item_id",
                order_col: str = "material_pos", clip_col: str = "clip",
                key: str = "key", pos: str = "pos", on_bad: str = "fail") -> DataFrame:
    """Concatenate the frames of an item's clips in material order.
    Slice ``[min(n,s) : min(n,e)+1)`` of the source equals ``pos BETWEEN s
    AND e`` (positions are < n). A clip is exploded into the few position
    buckets it covers and joined on (source, bucket) with the range as the
    residual, so it never meets frames far from it, and a popular source is
    spread over its buckets. Output position = clip offset + (pos - s).
    Output: item, pos, and the frame value columns."""
    lens = clip_lengths(clips, frames, item_col, order_col, clip_col, key, on_bad, pos) \
        .filter(F.col("len") > 0).select(item_col, "src", "s", "clip_offset", (F.col("s") + F.col("len") - 1).alias("e"))
    cell = lambda c: F.floor(c / CLIP_BUCKET)
    lens = lens.withColumn("_cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e")))))
    vals = [c for c in frames.columns if c not in (key, pos)]
    fr = frames.withColumnRenamed(key, "_fkey").withColumnRenamed(pos, "_fpos").withColumn("_fcell", cell(F.col("_fpos")))
    j = lens.join(fr, (F.col("src") == F.col("_fkey")) & (F.col("_cell") == F.col("_fcell"))
                  & F.col("_fpos").between(F.col("s"), F.col("e")))
    return j.select(item_col, (F.col("clip_offset") + F.col("_fpos") - F.col("s")).cast("int").alias(pos), *vals)


def _zero(df: DataFrame, col: str, zero=0.0):
    """A padding value of the column's type: for vectors, zeros of the width
    that the column's first row has."""
    kind = df.schema[col].dataType
    if kind.typeName() != "array":
        return F.lit(zero).cast(kind)
    row = df.select(F.size(col).alias("d")).first()
    return F.array_repeat(F.lit(zero), int(row["d"]) if row else 0).cast(kind)


def stride_sample(seq: DataFrame, length: int, key: str = "key", pos: str = "pos", on_bad: str = "fail") -> DataFrame:
    """Sequences of at least ``length`` rows: every ``gap = n // length``-th
    row, the first ``length`` of them (the tail past ``gap * length`` is
    dropped). Shorter ones: unchanged. Adds ``n`` (original length). The kept
    positions follow from the lengths and are joined on (key, position), so a
    hot key is spread and no row meets its whole sequence. Positions are proved
    first (:func:`proved_lengths`)."""
    lens = proved_lengths(seq.select(key, pos), key, pos, on_bad)
    gap = F.greatest(F.floor(F.col("n") / length), F.lit(1)).cast("int")
    last = F.least(F.col("n"), F.lit(length)).cast("int") - 1
    want = (lens.select(key, "n", gap.alias("_gap"), F.explode(F.sequence(F.lit(0), last)).alias("_out"))
            .select(key, "n", F.col("_out").cast("int").alias("_out"), (F.col("_out") * F.col("_gap")).cast("int").alias("_at")))
    vals = [c for c in seq.columns if c not in (key, pos)]
    fr = seq.select(key, F.col(pos).cast("int").alias("_at"), *vals)
    out = want.join(fr, [key, "_at"]).withColumnRenamed("_out", pos)
    return out.select(*seq.columns, "n")


def pad_mask(sampled: DataFrame, length: int, value_cols: Sequence[str], key: str = "key",
             pos: str = "pos", n_col: str = "n", zero=0.0) -> DataFrame:
    """Zero-pad each sequence to ``length`` and add ``mask`` (1 for real
    rows). Padding rows are generated per short sequence and unioned."""
    real = sampled.select(key, pos, *value_cols, F.lit(1).alias("mask"))
    short = (sampled.select(key, n_col).distinct().filter(F.col(n_col) < length)
             .select(key, F.explode(F.sequence(F.col(n_col).cast("int"), F.lit(length - 1))).alias(pos)))
    pads = short.select(key, pos, *[_zero(sampled, c, zero).alias(c) for c in value_cols],
                        F.lit(0).alias("mask"))
    return real.unionByName(pads)


def fixed_length(seq: DataFrame, length: int, value_cols: Sequence[str], key: str = "key",
                 pos: str = "pos", on_bad: str = "fail") -> DataFrame:
    """Reference collation of one modality: stride-sample long sequences,
    pad short ones, mask the padding. Only the kept rows' values move."""
    keys = seq.select(key).distinct().withColumn("lookup", F.col(key))
    return fixed_length_fetch(keys, seq, length, value_cols, key=key, pos=pos, on_bad=on_bad)


def fixed_length_fetch(keys: DataFrame, store: DataFrame, length: int, value_cols: Sequence[str],
                       key: str = "key", lookup: str = "lookup", pos: str = "pos", on_bad: str = "fail",
                       lengths: DataFrame | None = None) -> DataFrame:
    """Sample before fetch for a keyed lookup. ``keys`` maps
    an output ``key`` to a store key (``lookup``). Row counts come from the
    store with the value columns pruned, the kept positions follow from the
    counts (``pos * gap`` for ``pos < min(n, length)``), and only those rows
    are fetched with an equi join on ``(store key, pos)``; short sequences
    are padded. Same result as ``fixed_length`` on the joined sequences.
    Positions of the store are proved first (:func:`proved_lengths`), unless
    its proved ``lengths`` (key, n) are given."""
    vals = list(value_cols)
    n = (proved_lengths(store.select(key, pos), key, pos, on_bad) if lengths is None else lengths).select(F.col(key).alias(lookup), "n")
    lens = keys.select(key, lookup).join(n, lookup)
    gap = F.greatest(F.floor(F.col("n") / length), F.lit(1)).cast("int")
    m = F.least(F.col("n"), F.lit(length)).cast("int")
    want = (lens.select(key, lookup, gap.alias("_gap"), F.explode(F.sequence(F.lit(0), m - 1)).alias(pos))
            .select(key, lookup, F.col(pos).cast("int").alias(pos),
                    (F.col(pos) * F.col("_gap")).cast("int").alias("_src_pos")))
    fr = store.select(F.col(key).alias(lookup), F.col(pos).cast("int").alias("_src_pos"), *vals)
    real = want.join(fr, [lookup, "_src_pos"]).select(key, pos, *vals)
    return _pad_from_lengths(real, lens.select(key, "n"), length, {c: _zero(store, c) for c in vals}, key, pos)


def head_fetch(keys: DataFrame, store: DataFrame, length: int, value_cols: Sequence[str], key: str = "key", lookup: str = "lookup",
               pos: str = "pos", on_bad: str = "fail", lengths: DataFrame | None = None) -> DataFrame:
    """The first ``length`` rows of the sequences that ``keys`` look up, padded
    and masked; like :func:`fixed_length_fetch` without a stride."""
    vals = list(value_cols)
    n = (proved_lengths(store.select(key, pos), key, pos, on_bad) if lengths is None else lengths).select(F.col(key).alias(lookup), "n")
    lens = keys.select(key, lookup).join(n, lookup)
    last = F.least(F.col("n"), F.lit(length)).cast("int") - 1
    want = lens.select(key, lookup, F.explode(F.sequence(F.lit(0), last)).alias("_src_pos"))
    fr = store.filter(F.col(pos) < length).select(F.col(key).alias(lookup), F.col(pos).cast("int").alias("_src_pos"), *vals)
    real = want.join(fr, [lookup, "_src_pos"]).select(key, F.col("_src_pos").alias(pos), *vals)
    return _pad_from_lengths(real, lens.select(key, "n"), length, {c: _zero(store, c) for c in vals}, key, pos)


def whole_fetch(keys: DataFrame, store: DataFrame, lengths: DataFrame, value_cols: Sequence[str], key: str = "key",
                lookup: str = "lookup", pos: str = "pos") -> DataFrame:
    """Every row of the sequences that ``keys`` (key, lookup) look up, by
    (store key, position): with a store laid out by both, no value moves."""
    n = lengths.select(F.col(key).alias(lookup), "n")
    want = keys.select(key, lookup).join(n, lookup).select(key, lookup, F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("_src_pos"))
    fr = store.select(F.col(key).alias(lookup), F.col(pos).cast("int").alias("_src_pos"), *value_cols)
    return want.join(fr, [lookup, "_src_pos"]).select(key, F.col("_src_pos").alias(pos), *value_cols)


def sampled_clip_frames(clips: DataFrame, frames: DataFrame, length: int, value_cols: Sequence[str],
                        item_col: str = "item_id", order_col: str = "material_pos",
                        clip_col: str = "clip", key: str = "key", pos: str = "pos",
                        on_bad: str = "fail", lengths: DataFrame | None = None) -> DataFrame:
    """``fixed_length(clip_frames(...), length)`` without reading a vector
    that the stride sampling drops (SURVEY §4 R1): clip lengths and offsets
    come from frame counts only; per clip the kept output positions are a
    ``sequence(start, stop, gap)``; only those ``(src, pos)`` rows are joined
    for their values, then short items are padded. Output: item, pos,
    values…, mask."""
    cl = clip_lengths(clips, frames.select(key, pos), item_col, order_col, clip_col, key, on_bad, pos, lengths)
    # items whose clips are all empty still get `length` padding rows
    tot = cl.groupBy(item_col).agg(F.sum("len").alias("_n"))
    c = cl.filter(F.col("len") > 0).join(tot, item_col)
    gap = F.greatest(F.floor(F.col("_n") / length), F.lit(1)).cast("long")
    c = c.withColumn("_gap", gap)
    # concatenated positions q in [offset, offset + len) with q % gap = 0 and q / gap < length
    first = (F.ceil(F.col("clip_offset") / F.col("_gap")) * F.col("_gap")).cast("long")
    last = F.least(F.col("clip_offset") + F.col("len") - 1, (F.lit(length) - 1) * F.col("_gap")).cast("long")
    c = c.withColumn("_first", first).withColumn("_last", last).filter(F.col("_first") <= F.col("_last"))
    q = c.select(item_col, "src", "s", "clip_offset", "_gap", "_n",
                 F.explode(F.sequence("_first", "_last", "_gap")).alias("_q"))
    want = q.select(item_col, F.col("src").alias("_fkey"),
                    (F.col("s") + F.col("_q") - F.col("clip_offset")).cast("int").alias("_fpos"),
                    (F.col("_q") / F.col("_gap")).cast("int").alias(pos), "_n")
    vals = list(value_cols)
    fr = frames.select(F.col(key).alias("_fkey"), F.col(pos).alias("_fpos"), *vals)
    real = want.join(fr, ["_fkey", "_fpos"]).select(F.col(item_col).alias(key), pos, *vals,
                                                     F.col("_n").alias("n"))
    lens = tot.select(F.col(item_col).alias(key), F.col("_n").alias("n"))
    return _pad_from_lengths(real, lens, length, {c: _zero(frames, c) for c in vals}, key, pos)


def _pad_from_lengths(real: DataFrame, lens: DataFrame, length: int, zeros: dict,
                      key: str, pos: str) -> DataFrame:
    """Pad with ``zeros`` (value column -> padding value)."""
    out = real.select(key, pos, *zeros, F.lit(1).alias("mask"))
    short = lens.filter(F.col("n") < length).select(
        key, F.explode(F.sequence(F.col("n").cast("int"), F.lit(length - 1))).alias(pos))
    pads = short.select(key, pos, *[z.alias(c) for c, z in zeros.items()], F.lit(0).alias("mask"))
    return out.unionByName(pads)


def head_pad(seq: DataFrame, length: int, value_cols: Sequence[str], keys: DataFrame | None = None,
             key: str = "key", pos: str = "pos", zero=0.0, on_bad: str = "fail") -> DataFrame:
    """Keep the first ``length`` rows, zero-pad the rest, no mask. Keys in
    ``keys`` without any row get ``length`` zero rows."""
    head = seq.filter(F.col(pos) < length).select(key, pos, *value_cols)
    n = proved_lengths(seq.select(key, pos), key, pos, on_bad)
    if on_bad == "quarantine":
        head = head.join(n.select(key), key, "left_semi")
    if keys is not None:
        n = keys.select(key).distinct().join(n, key, "left").fillna(0, ["n"])
    short = n.filter(F.col("n") < length).select(
        key, F.explode(F.sequence(F.col("n").cast("int"), F.lit(length - 1))).alias(pos))
    pads = short.select(key, pos, *[_zero(seq, c, zero).alias(c) for c in value_cols])
    return head.unionByName(pads)


def frame_similarity(seq: DataFrame, key: str = "key", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(key, pos, _pid, _head, _near): the range partition of each frame
    (partitions are ordered by (key, pos)), whether it is its key's first, and
    its cosine similarity to the frame before it (null for the first and where
    a vector is missing). Vectors move once."""
    from ..session import cut_lineage
    order = [F.col(key).asc_nulls_first(), F.col(pos).asc()]
    ranged = seq.select(key, pos, vec).repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    w = Window.partitionBy("_pid").orderBy(*order)  # one range partition
    near = ranged.withColumn("_prev", F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), F.lag(vec).over(w))) \
        .withColumn("_first", F.row_number().over(w) == 1).withColumn("_turn", ~F.lag(key).over(w).eqNullSafe(F.col(key)))
    edge = ranged.groupBy("_pid").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(vec).alias("v")),
                                               F.struct(F.col(key), F.col(pos))).alias("_last"))
    before = Window.orderBy("_pid")  # a row per range partition
    edge = edge.select(F.col("_pid").alias("_epid"), F.lag("_last").over(before).alias("_edge"))
    j = near.join(edge, F.col("_pid") == F.col("_epid"))
    goes_on = F.col("_edge").isNotNull() & F.col("_edge.k").eqNullSafe(F.col(key))
    prev = F.when(F.col("_first") & goes_on, F.col("_edge.v")).otherwise(F.col("_prev"))
    head = F.when(F.col("_first"), ~goes_on).otherwise(F.col("_turn"))
    return j.select(key, pos, "_pid", head.alias("_head"), F.when(prev.isNotNull(), cosine(F.col(vec), prev)).alias("_near"))


def shot_segments(seq: DataFrame, threshold: float, key: str = "key", pos: str = "pos",
                  vec: str = "vec") -> DataFrame:
    """Cut a frame sequence where the cosine similarity to the previous frame
    falls below ``threshold``; one row per segment with the clip reference
    ``<key>_S<start>_E<end>``.

    Vectors move once, in the range shuffle that orders the frames: inside
    a range partition the previous frame is the row before, and only the first
    row of each partition asks for the last vector of the one before it (a row
    per partition). Everything after works on (key, pos, cut) rows: segment
    numbers and ends are running totals and ranks of narrow rows. A key holding
    a third of all frames is spread over every task."""
    from .ranking import rank_within
    near = frame_similarity(seq, key, pos, vec)
    cut = F.col("_near").isNull() | (F.col("_near") < F.lit(threshold))
    marks = near.select(key, F.col(pos), cut.alias("_cut"))
    r = rank_within(marks, [F.col(pos).asc()], by=[key], name="_rk", size_name="_n")
    cuts = r.filter("_cut").select(key, "_rk", F.col(pos).alias("start_pos"), "_n")
    seg = rank_within(cuts, [F.col("_rk").asc()], by=[key], name="_seg")
    nxt = seg.select(key, (F.col("_seg") - 1).alias("_seg"), F.col("_rk").alias("_next_rk"))
    seg = seg.join(nxt, [key, "_seg"], "left").withColumn(
        "_end_rk", F.coalesce(F.col("_next_rk") - 1, F.col("_n")))
    ends = r.select(key, F.col("_rk").alias("_end_rk"), F.col(pos).alias("end_pos"))
    out = seg.join(ends, [key, "_end_rk"])
    return out.select(
        key, (F.col("_seg") - 1).cast("int").alias("segment"), "start_pos", "end_pos",
        (F.col("_end_rk") - F.col("_rk") + 1).alias("n_frames"),
        F.concat(F.col(key).cast("string"), F.lit("_S"), F.col("start_pos").cast("string"),
                 F.lit("_E"), F.col("end_pos").cast("string")).alias("clip"))
