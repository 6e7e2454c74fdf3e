"""Max-cosine similarity of pool items to anchor items, top-k and
top-fraction selections (C7, D8, E2, E6, F1, SURVEY §4 P3).

The similarity is an all-pairs computation reduced to one number per pool
item. Pairs never become rows: both sides are packed into matrix blocks by the
executors, and a task keeps the running maxima of the pool block it works on.
It is exact, and skips what cannot win:

* ``PIVOTS`` vectors (a bounded sample of the anchors) stand for directions. An
  anchor belongs to its nearest pivot; anchors are sorted by pivot and angle, so
  a block is a ring around a pivot between two angles. Angles between
  directions obey the triangle inequality: from a pool row's own angle to the
  pivot follow the largest similarity the ring can hold and one it must reach.
* The rings of each group (fold) and pivot are a table of at most groups x
  pivots rows. A pool block that no row of which can find its maximum in a ring
  never meets the ring's blocks; a block that can't beat the running maxima is
  skipped when its turn comes.
* Pool rows are laid out by nearest pivot and dealt to ``spread`` parts (the
  cores of the cluster, whatever ``spark.sql.shuffle.partitions`` says). Anchor
  blocks travel only to parts that need them - a stated query set, in blocks.
  Nothing large passes through the driver and nothing is broadcast by hint.

Vectors without a usable direction (zero, tiny, not a number) are compared
without shortcuts. A pool packed once (:func:`pack_pool`) serves many rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import COSINE_EPS
from ..session import cut_lineage, release
from .ranking import rank_within

#: Target size of a packed block.
BLOCK_BYTES = 2 << 20
#: Directions that anchors are grouped by.
PIVOTS = 16
#: Shorter vectors have no direction to rely on.
LEAST_NORM = 1e-3
#: Slack for rounding in the bounds.
MARGIN = 1e-9
#: The pivot of vectors without a direction.
LOOSE = -1


def _matrix(vectors) -> np.ndarray:
    if any(v is None for v in vectors):
        raise ValueError("a row without a feature vector (missing features must be "
                         "failed or quarantined before scoring)")
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _flat_matrix(lists: pa.Array) -> np.ndarray:
    """As :func:`_matrix`, of an Arrow column in whole."""
    if lists.null_count:
        return _matrix(lists.to_pylist())
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (n != n[0]).any():
        raise ValueError("feature vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(n), n[0])


def _placed(pivots: np.ndarray):
    """Adds to every row of a batch its vector's nearest pivot and the angle to it."""
    def run(batches):
        for batch in batches:
            if len(batch):
                angles = _angles(_flat_matrix(batch.column("vec")), pivots) if len(pivots) else np.full((len(batch), 1), np.nan)
                pivot = _nearest(angles)
                angle = np.where(pivot == LOOSE, 0.0, angles[np.arange(len(batch)), pivot])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(angle, pa.float64())],
                                                 names=[*batch.schema.names, "pivot", "angle"])
    return run


def _blocks(x: np.ndarray, block_bytes: int):
    step = max(16, block_bytes // max(8, 8 * x.shape[1]))
    return ((lo, min(lo + step, len(x))) for lo in range(0, len(x), step))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to the (unit) pivots; NaN for rows without a direction."""
    n = _norms(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.arccos(np.clip((x @ pivots.T) / n[:, None], -1.0, 1.0))
    out[~(n >= LEAST_NORM) | ~np.isfinite(n)] = np.nan
    return out


def _nearest(angles: np.ndarray) -> np.ndarray:
    loose = np.isnan(angles).any(axis=1) if angles.shape[1] else np.ones(len(angles), dtype=bool)
    out = np.full(len(angles), LOOSE)
    out[~loose] = angles[~loose].argmin(axis=1) if (~loose).any() else LOOSE
    return out


#: Anchors that a block is multiplied with at once: the scratch of a task is
#: this many columns, whatever the blocks' sizes.
TILE = 256


def _max_cosine(x: np.ndarray, nx: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise max of ``x.a / max(|x||a|, eps)`` over anchors and the anchor
    that has it; NaN never wins."""
    na = _norms(a)
    top, at = np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
    # where no product of norms is below eps or not finite, a row's own norm changes no order: it divides the maximum
    plain = len(x) > 0 and len(a) > 0 and nx.min() * na.min() >= COSINE_EPS and np.isfinite(nx.max() * na.max())
    if plain:
        a = a / na[:, None]
    for lo in range(0, len(a), TILE):
        sims = x @ a[lo:lo + TILE].T
        if not plain:
            sims /= np.maximum(np.outer(nx, na[lo:lo + TILE]), COSINE_EPS)
            sims[np.isnan(sims)] = -np.inf
        value = sims.max(axis=1)
        won = np.flatnonzero(value > top)
        top[won], at[won] = value[won], sims[won].argmax(axis=1) + lo
    return (top / nx if plain else top), at


def _most(angles, low, high):
    """The largest cosine that a ring between angles ``low`` and ``high``
    around a pivot can have with a row at ``angles`` to the pivot."""
    return np.cos(np.maximum(0.0, np.maximum(angles - high, low - angles)))


@dataclass
class PackedPool:
    """Pool rows in blocks, laid out by nearest pivot; written once."""
    blocks: DataFrame   # salt, block, ids, open, n, mat, angles
    pivots: np.ndarray  # unit vectors
    spread: int

    def release(self) -> None:
        release(self.blocks)


def draw_pivots(vectors: DataFrame, vec_col: str = "fea", pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` unit vectors, drawn by hash (any vectors would do:
    they only decide how much is skipped)."""
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(x.alias("v")).filter("v is not null").orderBy(F.xxhash64("v")).limit(pivots).collect()
    if not rows:
        return np.zeros((0, 1))
    m = _matrix([r.v for r in rows])
    n = _norms(m)
    keep = (n >= LEAST_NORM) & np.isfinite(n)
    return m[keep] / n[keep, None]


def pack_pool(pool: DataFrame, pivots: np.ndarray, id_col: str = "video_id", vec_col: str = "fea", open_col: str | Column | None = None,
              spread: int | None = None, block_bytes: int = BLOCK_BYTES) -> PackedPool:
    """``pool`` in blocks. ``open_col``: the groups (array of strings) a row
    asks for; none: it asks for all."""
    spread = spread or max(1, pool.sparkSession.sparkContext.defaultParallelism)
    opened = F.lit(None).cast("array<string>") if open_col is None else (F.col(open_col) if isinstance(open_col, str) else open_col)
    rows = pool.select(F.col(id_col).cast("string").alias("id"), opened.cast("array<string>").alias("open"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
    near = T.StructType([*rows.schema, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def packed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["vec"].values)
            for lo, hi in _blocks(x, block_bytes):
                part = x[lo:hi]
                angles = _angles(part, pivots) if len(pivots) else np.zeros((hi - lo, 0))
                opens = [None if o is None else list(o) for o in pdf["open"].iloc[lo:hi]]
                yield pd.DataFrame({"salt": [int(pdf["salt"].iloc[lo])], "ids": [pdf["id"].iloc[lo:hi].tolist()], "open": [opens],
                                    "n": [hi - lo], "mat": [part.tobytes()], "angles": [angles.tobytes()]})

    laid = rows.mapInArrow(_placed(pivots), near).repartitionByRange(spread, "pivot", "angle", F.xxhash64("id")).sortWithinPartitions("pivot", "angle")
    blocks = (laid.select(F.spark_partition_id().alias("salt"), "id", "open", "vec")
              .mapInPandas(packed, "salt int, ids array<string>, open array<array<string>>, n int, mat binary, angles binary")
              .withColumn("block", F.monotonically_increasing_id()))
    return PackedPool(cut_lineage(blocks), pivots, spread)


def _pack_anchors(anchors: DataFrame, pivots: np.ndarray, block_bytes: int) -> DataFrame:
    """Anchor blocks: grp, pivot, low and high (angles to the pivot), ids, m,
    anchors; ``anchors`` has grp, id, vec."""
    near = T.StructType([*anchors.schema, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def packed(batches):
        for pdf in batches:
            for (grp, pivot), rows in pdf.groupby(["grp", "pivot"], sort=False):
                x, angle = _matrix(rows["vec"].values), rows["angle"].to_numpy()
                for lo, hi in _blocks(x, block_bytes):
                    yield pd.DataFrame({"grp": [grp], "pivot": [int(pivot)], "low": [angle[lo:hi].min()], "high": [angle[lo:hi].max()],
                                        "names": [rows["id"].iloc[lo:hi].tolist()], "m": [hi - lo], "anchors": [x[lo:hi].tobytes()]})

    laid = anchors.mapInArrow(_placed(pivots), near).repartitionByRange("grp", "pivot", "angle").sortWithinPartitions("grp", "pivot", "angle")
    return cut_lineage(laid.mapInPandas(packed, "grp string, pivot int, low double, high double, names array<string>, m int, anchors binary"))


def _needed(opens, n: int, angles: np.ndarray, rings: dict) -> list[str]:
    """Which rings (``grp|pivot``) some row of a pool block may find a maximum
    in. ``rings``: grp -> pivot -> (low, high)."""
    out = []
    loose = np.isnan(angles).any(axis=1) if angles.shape[1] else np.ones(n, dtype=bool)
    for grp, own in rings.items():
        asks = np.asarray([o is None or grp in o for o in opens])
        if not asks.any():
            continue
        turned = [p for p in own if p != LOOSE]
        sure = np.full(n, -1.0)  # a similarity that each row surely reaches
        for p in turned:
            sure = np.maximum(sure, np.cos(np.minimum(np.pi, angles[:, p] + own[p][0])))
        for p in own:
            if p == LOOSE or (asks & (loose | ~(_most(angles[:, p], *own[p]) < sure - MARGIN))).any():
                out.append(f"{grp}|{p}")
    return out


def _running_max(pivots: np.ndarray, groups: list[str], met=None, skipped=None):
    """Joined (pool block, anchor block) rows; those of one pool block come
    together, its maxima are emitted when the next one begins."""
    def run(batches):
        block, best = None, {}

        def flush():
            ids, opens = block["ids"], block["opens"]
            for g in groups:
                mine = np.flatnonzero([o is None or g in o for o in opens])
                top, names = best[g]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(mine)), pa.array([g] * len(mine), pa.string()), pa.array(np.maximum(top[mine], -1.0), pa.float64()),
                     pa.array(names[mine], pa.string())], names=["id", "grp", "sim", "name"])

        def doubles(batch, name, i, n):
            return np.frombuffer(batch.column(name)[i].as_buffer(), dtype=np.float64).reshape(n, -1)

        for batch in batches:  # of the lists only those of new blocks and of winners are looked at
            blocks, grps, ns, ms = (batch.column(c).to_pylist() for c in ("block", "grp", "n", "m"))
            rings = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "low", "high"))))
            for i, (number, grp, n) in enumerate(zip(blocks, grps, ns)):
                if block is None or block["block"] != number:
                    if block is not None:
                        yield from flush()
                    x, angles = doubles(batch, "mat", i, n).copy(), doubles(batch, "angles", i, n).copy()
                    opens = [None if o is None else set(o) for o in batch.column("open")[i].as_py()]
                    block = {"block": number, "ids": batch.column("ids")[i].values, "opens": opens, "x": x, "norms": _norms(x), "angles": angles,
                             "loose": np.isnan(angles).any(axis=1) if angles.shape[1] else np.ones(n, dtype=bool),
                             "asks": {g: np.asarray([o is None or g in o for o in opens]) for g in groups}}
                    best = {g: (np.full(n, -np.inf), np.full(n, None, dtype=object)) for g in groups}
                if grp is None:
                    continue
                (top, names), (pivot, low, high) = best[grp], rings[i]
                may = np.ones(n, dtype=bool)
                if pivot != LOOSE:
                    may = block["loose"] | ~(_most(block["angles"][:, pivot], low, high) < top - MARGIN)
                may &= block["asks"][grp]
                if not may.any():
                    if skipped is not None:
                        skipped.add(1)
                    continue
                if met is not None:
                    met.add(1)
                a = doubles(batch, "anchors", i, ms[i])
                rows = np.flatnonzero(may)
                sims, at = _max_cosine(block["x"][rows], block["norms"][rows], a)
                won = sims > top[rows]
                top[rows[won]] = sims[won]
                names[rows[won]] = np.asarray(batch.column("names")[i].as_py(), dtype=object)[at[won]]
        if block is not None:
            yield from flush()
    return run


def _pairs(pool: PackedPool, needs: DataFrame, sent: DataFrame) -> DataFrame:
    """Pool blocks, each with the anchor blocks sent to its part that it needs
    (or none). A part is a task of its own: hashed, parts would share tasks and
    leave cores without work."""
    asking = pool.blocks.join(needs.select("block", "needs"), "block")
    p, s = (side.repartitionById(pool.spread, F.col("salt").cast("int")).alias(a) for side, a in ((asking, "p"), (sent, "s")))
    return p.join(s, (F.col("p.salt") == F.col("s.salt")) & F.array_contains("p.needs", F.col("s.ring")), "left").select(
        "p.block", "p.ids", "p.open", "p.n", "p.mat", "p.angles", "s.grp", "s.pivot", "s.low", "s.high", "s.names", "s.m", "s.anchors")


def best_anchors(pool: PackedPool, anchors: DataFrame, groups: Sequence[str], block_bytes: int = BLOCK_BYTES, met=None, skipped=None) -> DataFrame:
    """(id, grp, sim, name): for every pool row and each of ``groups`` that it
    asks for, the largest similarity to the group's ``anchors`` (grp, id, vec)
    and the anchor that has it; -1 and null without any. ``met`` and
    ``skipped`` are accumulators that count block pairs."""
    groups, pivots = list(groups), pool.pivots
    blocks = _pack_anchors(anchors.filter(F.col("grp").isin(groups)), pivots, block_bytes)
    rings: dict = {}
    for r in blocks.groupBy("grp", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # groups x pivots rows
        rings.setdefault(r.grp, {})[r.pivot] = (r.low, r.high)

    def asked(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"salt": pdf["salt"], "block": pdf["block"], "needs": [
                    _needed(list(o), n, np.frombuffer(a, dtype=np.float64).reshape(n, -1), rings)
                    for o, n, a in zip(pdf["open"], pdf["n"], pdf["angles"])]})

    needs = cut_lineage(pool.blocks.select("salt", "block", "open", "n", "angles").mapInPandas(asked, "salt int, block long, needs array<string>"))
    ring = F.concat_ws("|", "grp", F.col("pivot").cast("string"))
    parts = needs.select("salt", F.explode("needs").alias("ring")).distinct()  # at most spread x groups x pivots rows
    sent = blocks.withColumn("ring", ring).join(parts, "ring")
    got = _pairs(pool, needs, sent).mapInArrow(_running_max(pivots, groups, met, skipped), "id string, grp string, sim double, name string")
    best = F.max(F.struct("sim", "name"))  # blocks that Spark may have split
    return got.groupBy("id", "grp").agg(best.alias("b")).select("id", "grp", "b.sim", "b.name")


def max_similarity(pool: DataFrame, anchors: DataFrame, by: Sequence[str] = (),
                   id_col: str = "video_id", vec_col: str = "fea", out_col: str = "similarity",
                   open_col: str | None = None, spread: int | None = None,
                   block_bytes: int = BLOCK_BYTES, pivots: int = PIVOTS, met=None, skipped=None) -> DataFrame:
    """For every pool id and group: the largest cosine similarity to any anchor
    of the group, or -1 when it has none. ``by`` is at most one group column of
    the anchors; a pool row belongs to the groups in its ``open_col`` (an
    array), or to the one in its own ``by`` column. Output: ``by…, id_col,
    out_col``, one row per id and group."""
    by = list(by)
    if len(by) > 1:
        raise ValueError("at most one group column")
    group = F.col(by[0]).cast("string") if by else F.lit("")
    opened = F.col(open_col) if open_col else F.array(group)
    queries = anchors.select(F.coalesce(group, F.lit("")).alias("grp"), F.lit("").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    packed = pack_pool(pool, draw_pivots(queries, "vec", pivots), id_col, vec_col, opened, spread, block_bytes)
    asked = packed.blocks.select(F.explode(F.flatten("open")).alias("g")).distinct()
    groups = [r.g for r in asked.collect()]  # the groups (folds) that rows ask for
    out = best_anchors(packed, queries, groups, block_bytes, met, skipped)
    cols = [F.col("grp").cast(anchors.schema[by[0]].dataType).alias(by[0])] if by else []
    return out.select(*cols, F.col("id").cast(pool.schema[id_col].dataType).alias(id_col), F.col("sim").alias(out_col))


def topk(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows by ``order`` (per ``by`` group). A constant limit, so
    Spark plans TakeOrderedAndProject or a partial WindowGroupLimit that cuts
    every map partition to ``k`` rows per group before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def top_ranked(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (),
               rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows by ``order`` per group where ``k`` grows with the data:
    a two-level rank instead of a window that would sort whole groups. Pass
    narrow rows."""
    return rank_within(df, order, by=by, name=rank_col, groups_bounded=True).filter(F.col(rank_col) <= k)


def top_fraction(df: DataFrame, fraction: float, order: Sequence[Column],
                 by: Sequence[str] = (), rank_col: str = "rank",
                 groups_bounded: bool | None = None) -> DataFrame:
    """The ``floor(n * fraction)`` first rows of each group (``int(n*0.3)`` in
    the reference). The limit depends on the group size, so this uses the
    two-level rank rather than a window over whole groups."""
    ranked = rank_within(df, order, by=by, name=rank_col, size_name="_gn",
                         groups_bounded=groups_bounded)
    return ranked.filter(F.col(rank_col) <= F.floor(F.col("_gn") * F.lit(fraction))).drop("_gn")
