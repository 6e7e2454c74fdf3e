"""A softmax head trained in epochs, all folds at once.

The weights of all folds are ``k x classes x (d + 1)`` numbers (the last one of
a row is the bias), whatever the data size; a check bounds their bytes. One
pass over the training table serves every fold: a task reads its rows in Arrow
batches, multiplies them with all folds' weights, and hands on one vector per
fold - the sum of the gradients of the rows that train the fold, their loss,
and the confusion counts of the rows that validate it. Spark adds these vectors
up in partial aggregates. So the pass that gives the next epoch's gradient also
gives the validation figures of the weights it started from.

Per fold and epoch: mean gradient, clipped to a norm, plus weight decay. The
best epoch by validation macro F1 is kept (strictly better than all before,
from 0), and a fold stops once ``patience`` epochs have gone by without a
better one; its rows are still read but no longer used. A fold that never
scores above 0 keeps the weights it started with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of all folds may take this many bytes in a task's closure.
MAX_WEIGHT_BYTES = 64 << 20
CLASSES = 2


@dataclass
class EpochParams:
    """Training settings; the defaults of epochs, patience and threshold are
    the reference's."""
    epochs: int = 30
    patience: int = 5
    threshold: float = 0.6   # a best epoch above it is worth keeping as a final model
    lr: float = 0.5
    weight_decay: float = 0.0
    clip: float | None = 1.0

    def __post_init__(self):
        if self.epochs < 0 or self.patience < 1 or self.lr <= 0:
            raise ValueError("epochs >= 0, patience >= 1 and lr > 0 required")


def macro_f1(c) -> float | None:
    """Macro F1 of the counts (00, 01, 10, 11) over the classes present."""
    c00, c01, c10, c11 = (float(x) for x in c)
    out = [2 * t / (2 * t + c01 + c10) for t, present in ((c00, c00 + c01 + c10), (c11, c11 + c01 + c10)) if present > 0]
    return sum(out) / len(out) if out else None


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of one width, with a column of ones."""
    if column.null_count or not len(column):
        raise ValueError("a row without a feature vector")
    offsets = np.asarray(column.offsets)
    width = int(offsets[1] - offsets[0])
    if not (np.diff(offsets) == width).all():
        raise ValueError("feature vectors of several widths")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def fold_sums(rows: DataFrame, weights: np.ndarray, active: list[int] | None = None) -> dict[int, np.ndarray]:
    """One pass over ``rows`` (runs array<int>: folds that a row trains; val
    int: the fold it validates, or -1; y; fea): per fold a vector of the
    gradient sum, the loss sum, the number of training rows and the four
    validation counts, all under ``weights``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    if weights.nbytes > MAX_WEIGHT_BYTES:
        raise ValueError(f"the weights of all folds take {weights.nbytes} bytes; the bound is {MAX_WEIGHT_BYTES}")
    k = len(weights)
    use = np.zeros(k, dtype=bool)
    use[list(range(k)) if active is None else active] = True

    def run(batches):
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("fea"))
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            runs, val = batch.column("runs"), batch.column("val").to_numpy(zero_copy_only=False)
            trains = np.zeros((len(x), k), dtype=bool)
            trains[np.repeat(np.arange(len(x)), np.diff(np.asarray(runs.offsets))), runs.flatten().to_numpy(zero_copy_only=False)] = True
            trains &= use
            z = np.einsum("nd,kcd->nkc", x, weights, optimize=True)
            z -= z.max(axis=2, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=2, keepdims=True)
            mine = np.arange(len(x))
            loss = (-(z[mine, :, y] - np.log(np.exp(z).sum(axis=2))) * trains).sum(axis=0)
            slope = p
            slope[mine, :, y] -= 1.0
            slope *= trains[:, :, None]
            grad = np.einsum("nkc,nd->kcd", slope, x, optimize=True).reshape(k, -1)
            counts = np.zeros((k, 4))
            held = (val >= 0) & (val < k)
            pred = z.argmax(axis=2)[mine[held], val[held]]
            np.add.at(counts, (val[held], 2 * y[held] + pred), 1)
            got = np.concatenate([grad, loss[:, None], trains.sum(axis=0)[:, None], counts], axis=1)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["fold", "v"])

    each = rows.select("runs", "val", "y", F.col("fea").cast("array<double>").alias("fea")).mapInArrow(run, "fold int, v array<double>")
    sums = each.groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return {r.fold: np.asarray(r.v) for r in sums.collect()}  # a row a fold


def fit_epochs(rows: DataFrame, start: np.ndarray, params: EpochParams,
               folds: list[int] | None = None) -> tuple[np.ndarray, list[tuple]]:
    """(weights of each fold's best epoch, history). ``rows`` as in
    :func:`fold_sums`, written by the caller, as every epoch reads them.
    History: (fold, epoch from 1, training loss before the epoch's step,
    validation F1 after it)."""
    k, size = len(start), start[0].size
    weights, best = start.copy(), start.copy()
    best_f1, best_epoch = np.zeros(k), np.zeros(k, dtype=int)
    active = list(range(k)) if folds is None else list(folds)
    history: list[tuple] = []
    loss = {}
    for epoch in range(params.epochs + 1):
        if not active:
            break
        sums = fold_sums(rows, weights, active)
        for f in list(active):
            v = sums.get(f)
            if v is None or v[size + 1] == 0:
                active.remove(f)  # nothing to train on
                continue
            if epoch:
                f1 = macro_f1(v[size + 2:])
                history.append((f, epoch, loss[f], f1))
                if f1 is not None and f1 > best_f1[f]:
                    best_f1[f], best_epoch[f], best[f] = f1, epoch, weights[f]
                elif epoch - best_epoch[f] >= params.patience:
                    active.remove(f)
                    continue
            n = v[size + 1]
            loss[f] = float(v[size] / n)
            g = (v[:size] / n).reshape(weights[f].shape)
            if params.clip is not None:
                g = g * min(1.0, params.clip / (np.sqrt((g * g).sum()) + 1e-6))
            weights[f] = weights[f] - params.lr * (g + params.weight_decay * weights[f])
    return best, history


def training_rows(train: DataFrame, k: int, pool: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """The table every epoch reads. ``train`` (fold, y, fea): a row trains all
    folds but its own, which it validates. ``members`` (fold, video_id): pool
    ids that a fold trains on; every row of such an id in ``pool`` counts."""
    runs = F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.array(F.col("fold").cast("int")))
    out = train.select(runs.alias("runs"), F.col("fold").cast("int").alias("val"), "y", "fea")
    if members is None:
        return out
    folds = members.groupBy("video_id").agg(F.collect_set(F.col("fold").cast("int")).alias("runs"))  # at most k folds an id
    extra = pool.join(folds, "video_id").select("runs", F.lit(-1).alias("val"), "y", "fea")
    return out.unionByName(extra)


def weights_table(spark, weights: np.ndarray) -> DataFrame:
    """fold, cls, w, b: one row per fold and class."""
    rows = [(f, c, [float(v) for v in weights[f, c, :-1]], float(weights[f, c, -1]))
            for f in range(len(weights)) for c in range(weights.shape[1])]
    return spark.createDataFrame(rows, "fold int, cls int, w array<double>, b double")


def weights_array(model: DataFrame) -> np.ndarray:
    rows = sorted(model.select("fold", "cls", "w", "b").collect())  # folds x classes rows
    k = len({r.fold for r in rows})
    return np.asarray([[*r.w, r.b] for r in rows], dtype=np.float64).reshape(k, -1, len(rows[0].w) + 1)
