"""Per-item feature assembly from long-form stores.

The modalities are declared (:class:`Modality`), and the plan is built from the
declarations. Every lookup is an equi join on a key computed first (never an OR
join); by default text by item id, audio by the first material's source, motion
by the conditional motion key, frames by the clip range join. Output stays long:
``(video_id, modality, pos, value…, mask)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import audio_key, motion_key
from ..session import cut_lineage
from ..sources.store import BucketedStore
from .sequences import (AUDIO_LEN, FRAME_LEN, dense_lengths, fixed_length_fetch, head_fetch, lengths_or_fail,
                        parse_clips, sampled_clip_frames, sequence_proof, whole_fetch, without_bad)

#: How a modality's stored sequence becomes its rows: every row; a fixed length
#: by stride sampling or by its first rows, padded with zeros; or the frames of
#: an item's clips, cut out of their sources and stride-sampled.
SAMPLING = ("whole", "stride", "head", "clips")


@dataclass(frozen=True)
class Modality:
    """What one modality is made of (J3). ``key`` says which sequence of the
    store an item reads: a column name, or a function of no arguments that gives
    a Column; for ``clips`` it is the column with the list of clip references.
    ``length`` is the fixed number of rows (none for ``whole``)."""
    name: str
    store: str
    key: str | Callable[[], Column]
    how: str = "stride"
    length: int | None = None

    def __post_init__(self):
        if self.how not in SAMPLING:
            raise ValueError(f"{self.name}: {self.how!r} is none of {', '.join(SAMPLING)}")
        if (self.length is None) != (self.how == "whole") or (self.length is not None and self.length < 1):
            raise ValueError(f"{self.name}: a length goes with every sampling but 'whole'")
        if self.how == "clips" and not isinstance(self.key, str):
            raise ValueError(f"{self.name}: the clips are a column")

    def column(self) -> Column:
        return F.col(self.key) if isinstance(self.key, str) else self.key()


def default_modalities(id_col: str = "video_id", materials: str = "visual_materials") -> tuple[Modality, ...]:
    """The published set: text as stored, 50 audio rows, 83 frames cut by clips
    and 83 motion rows."""
    return (Modality("text", "text", id_col, "whole"), Modality("audio", "audio", lambda: audio_key(materials), "stride", AUDIO_LEN),
            Modality("frames", "frames", materials, "clips", FRAME_LEN), Modality("motion", "motion", lambda: motion_key(id_col), "stride", FRAME_LEN))


MODALITIES = tuple(m.name for m in default_modalities())


def item_keys(items: DataFrame, id_col: str = "video_id",
              materials: str = "visual_materials") -> DataFrame:
    """video_id, text_key, audio_key, motion_key."""
    return items.select(id_col, F.col(id_col).alias("text_key"),
                        audio_key(materials).alias("audio_key"), motion_key(id_col).alias("motion_key"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_features(items: DataFrame, stores: dict[str, DataFrame], id_col: str = "video_id",
                     materials: str = "visual_materials", key: str = "key",
                     modalities: Sequence[Modality] | None = None, lengths: dict[str, DataFrame] | None = None) -> DataFrame:
    """video_id, modality, missing_key for every lookup that finds nothing
    (the reference dies on the first one). Anti joins against the distinct
    store keys, which a bucketed store has at hand; ``lengths`` (key, a row
    each) are those of other stores, by name, if they are at hand."""
    spark = items.sparkSession
    have_keys = lambda s: s.lengths(spark).select(key) if isinstance(s, BucketedStore) else s.select(key).distinct()
    parts = []
    for m in modalities or default_modalities(id_col, materials):
        have = lengths[m.store].select(key) if m.store in (lengths or {}) else have_keys(stores[m.store])
        have = have.withColumnRenamed(key, "missing_key")
        if m.how != "clips":
            asked = items.select(F.col(id_col), F.lit(m.name).alias("modality"), m.column().alias("missing_key"))
            parts.append(asked.join(have, "missing_key", "left_anti").select(id_col, "modality", "missing_key"))
            continue
        mats = items.select(id_col, F.explode_outer(m.key).alias("clip"))
        parsed = parse_clips(mats.filter(F.col("clip").isNotNull()))
        srcs = parsed.filter("valid").select(id_col, F.col("src").alias("missing_key"))
        parts.append(srcs.join(have, "missing_key", "left_anti").select(id_col, F.lit(m.name).alias("modality"), "missing_key").distinct())
        # a malformed clip or an empty material list fails the reference's frame
        # loop: report it so the item fails or is quarantined, never half-built
        parts.append(parsed.filter(~F.col("valid")).select(id_col, F.col("clip").alias("missing_key"))
                     .unionByName(mats.filter(F.col("clip").isNull()).select(id_col, F.lit("").alias("missing_key")))
                     .select(id_col, F.lit("clip").alias("modality"), "missing_key"))
    return _union(parts)


def feature_assemble(items: DataFrame, stores: dict[str, DataFrame], value_cols: Sequence[str] = ("x",),
                     id_col: str = "video_id", materials: str = "visual_materials",
                     key: str = "key", pos: str = "pos", on_missing: str = "fail",
                     modalities: Sequence[Modality] | None = None) -> DataFrame:
    """The ``modalities`` of each item in long form (default: the published
    four). The plan follows from their declarations: whole sequences are looked
    up, fixed lengths are sampled from sequence lengths alone and only the kept
    rows are fetched, short ones are padded with zeros (mask 0).
    ``on_missing='fail'`` raises like the reference when any lookup misses;
    ``'quarantine'`` drops such items. A sequence with gaps or repeats raises
    when it is read, or takes the items that read it out; a store's sequences
    are proved once, and the proof (a row a sequence) is written. A store is a DataFrame
    or a :class:`BucketedStore`, whose vectors stay where they lie."""
    vc, specs = list(value_cols), list(modalities or default_modalities(id_col, materials))
    if on_missing not in ("fail", "quarantine"):
        raise ValueError(on_missing)
    if len({m.name for m in specs}) < len(specs) or not specs:
        raise ValueError("modalities need names of their own")
    if absent := sorted({m.store for m in specs} - set(stores)):
        raise ValueError(f"no store named {', '.join(absent)}")
    stores = {m.store: stores[m.store] for m in specs}
    plain = {id(s): s for s in stores.values() if not isinstance(s, BucketedStore)}
    if on_missing == "fail":
        bad = missing_features(items, stores, id_col, materials, key, specs).limit(1).collect()
        if bad:
            raise KeyError(f"missing {bad[0]['modality']} features for {bad[0][id_col]!r} "
                           f"(key {bad[0]['missing_key']!r})")
    else:
        # a sequence whose positions prove nothing is as good as missing
        proofs = {i: cut_lineage(sequence_proof(s.select(key, pos), key, pos)) for i, s in plain.items()}  # modalities may share a store
        sound = {i: without_bad(s, proofs[i], key) for i, s in plain.items()}
        known = {n: dense_lengths(proofs[id(s)], key) for n, s in stores.items() if id(s) in plain}
        stores = {m: sound.get(id(s), s) for m, s in stores.items()}
        miss = missing_features(items, stores, id_col, materials, key, specs, known)
        items = items.join(miss.select(id_col).distinct(), id_col, "left_anti")
    spark = items.sparkSession
    if on_missing == "fail":
        # one proof a store, written: each of its modalities asks for the lengths twice, for rows and for padding
        sampled = {id(stores[m.store]) for m in specs if m.how != "whole"}
        proofs = {i: cut_lineage(sequence_proof(s.select(key, pos), key, pos)) for i, s in plain.items() if i in sampled}
        known = {n: lengths_or_fail(proofs[id(s)], key) for n, s in stores.items() if id(s) in proofs}
    lengths = {n: s.lengths(spark) if isinstance(s, BucketedStore) else known.get(n) for n, s in stores.items()}
    rows = {n: s.rows(spark) if isinstance(s, BucketedStore) else s for n, s in stores.items()}

    def built(m: Modality) -> DataFrame:
        store, n = rows[m.store], lengths[m.store]
        if m.how == "clips":
            clips = items.select(id_col, F.posexplode(m.key).alias("_mp", "clip"))
            return sampled_clip_frames(clips, store, m.length, vc, item_col=id_col, order_col="_mp", clip_col="clip",
                                       key=key, pos=pos, on_bad="checked", lengths=n)
        asked = items.select(F.col(id_col).alias(key), m.column().alias("lookup"))
        if m.how == "stride":
            return fixed_length_fetch(asked, store, m.length, vc, key=key, lookup="lookup", pos=pos, lengths=n)
        if m.how == "head":
            return head_fetch(asked, store, m.length, vc, key=key, lookup="lookup", pos=pos, lengths=n)
        if isinstance(stores[m.store], BucketedStore):
            return whole_fetch(asked, store, n, vc, key=key, pos=pos).withColumn("mask", F.lit(1))
        found = asked.join(store.withColumnRenamed(key, "lookup"), "lookup")
        return found.select(key, pos, *vc).withColumn("mask", F.lit(1))

    return _union([built(m).select(F.col(key).alias(id_col), F.lit(m.name).alias("modality"), pos, *vc, "mask") for m in specs])


#: Vectors up to this width are summed by a column a dimension.
POOL_COLUMNS = 90


def sequence_mean_pool(seq: DataFrame, by: Sequence[str] = ("key",), vec: str = "vec",
                       masked: bool = False, mask: str = "mask", width: int | None = None) -> DataFrame:
    """Mean over positions, per dimension: by…, d, mean. With
    ``masked=False`` (the reference) padding rows count; with ``True`` only
    rows whose mask is 1. Whole vectors are averaged by Spark ML's
    ``Summarizer`` (partial + final aggregate, no per-dimension explode);
    only the pooled vector is unpivoted to long form. If their ``width`` is
    known and not large, plain sums do it: they stay in a hash table, where the
    ``Summarizer`` sorts all vectors of a task with many keys; a vector of
    another width, or with a null entry, raises when the result is computed."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    by = list(by)
    src = seq.filter(F.col(mask) == 1) if masked else seq
    if width and width <= POOL_COLUMNS:
        x, n = F.col(vec), F.count(F.lit(1))
        fits = F.coalesce((F.size(x) == width) & F.forall(x, lambda v: v.isNotNull()), F.lit(False))
        first = F.when(fits, F.get(x, F.lit(0)).cast("double")).otherwise(F.raise_error(f"a vector that has not {width} entries").cast("double"))
        sums = [F.sum(first if d == 0 else F.get(x, F.lit(d)).cast("double")) for d in range(width)]
        pooled = src.groupBy(*by).agg(F.array(*[s / n for s in sums]).alias("_m"))
        return pooled.select(*by, F.posexplode("_m").alias("d", "mean"))
    pooled = src.groupBy(*by).agg(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_m"))
    return pooled.select(*by, F.posexplode(vector_to_array("_m")).alias("d", "mean"))


def modality_mean_fusion(pooled: Sequence[DataFrame], by: Sequence[str] = ("key",),
                         on_missing: str = "fail") -> DataFrame:
    """Element-wise mean of the pooled vectors of several modalities (long
    form ``by…, d, mean``): one union and one aggregate instead of a
    multi-way join. A key that lacks a modality raises (``'fail'``, when the
    result is computed) or is left out whole (``'quarantine'``)."""
    if on_missing not in ("fail", "quarantine"):
        raise ValueError(on_missing)
    by = list(by)
    u = None
    for p in pooled:
        s = p.select(*by, "d", "mean")
        u = s if u is None else u.unionByName(s)
    fused = u.groupBy(*by, "d").agg(F.avg("mean").alias("fused"), F.count(F.lit(1)).alias("n_modalities"))
    if on_missing == "quarantine":
        short = fused.filter(F.col("n_modalities") != len(pooled)).select(*by).distinct()
        return fused.join(short, by, "left_anti")
    what = F.concat_ws(" ", F.lit("a modality is missing for"), *[F.col(b).cast("string") for b in by])
    return fused.withColumn("n_modalities", F.when(F.col("n_modalities") == len(pooled), F.col("n_modalities"))
                            .otherwise(F.raise_error(what).cast("long")))


def fused_items(items: DataFrame, stores: dict[str, DataFrame], id_col: str = "video_id", materials: str = "visual_materials",
                vec: str = "vec", on_missing: str = "fail") -> DataFrame:
    """The data path of one item vector: assemble the four modalities, mean-pool
    each (padding rows count, as in the reference) and average them element by
    element. Output: id, fea."""
    long = feature_assemble(items.select(id_col, materials).distinct(), stores, (vec,), id_col, materials, on_missing=on_missing)
    firsts = [s.rows(items.sparkSession) if isinstance(s, BucketedStore) else s for s in {id(s): s for s in stores.values()}.values()]
    widths = {r.n for s in firsts for r in s.select(F.size(vec).alias("n")).limit(1).collect()}
    pooled = sequence_mean_pool(long, [id_col, "modality"], vec, width=widths.pop() if len(widths) == 1 else None)
    parts = [pooled.filter(F.col("modality") == m).drop("modality") for m in MODALITIES]
    fused = modality_mean_fusion(parts, [id_col], on_missing)
    rows = fused.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("d", "fused", "n_modalities"))).alias("_f"))
    return rows.select(id_col, F.col("_f.fused").alias("fea"))  # one vector: as many entries as dimensions
