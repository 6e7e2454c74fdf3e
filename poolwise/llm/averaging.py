"""Data-parallel training: tasks go on from one model, their changes are
averaged.

A model is a dict of named arrays. A change travels in pieces of bounded size,
multiplied by what its task has learned from (``seen``), and tasks add the
pieces up; so nothing but one model's sums reaches the driver, however many
tasks there are. In ``sparse`` arrays each row is averaged over the tasks that
moved it, in the others over all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 14
SCHEMA = "part int, v binary"


def moves(before: dict[str, np.ndarray], after: dict[str, np.ndarray], seen: float):
    """A task's rows: its change, and which rows it moved, times ``seen``."""
    out = []
    for k in sorted(before):
        moved = np.atleast_1d(after[k] - before[k])
        out += [moved.ravel() * np.float32(seen), (moved.reshape(len(moved), -1) != 0).any(1) * np.float32(seen)]
    flat = np.concatenate(out).astype(np.float32)
    for i, at in enumerate(range(0, len(flat), PIECE)):
        piece = flat[at:at + PIECE]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["part", "v"])


def _add(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column("part").to_pylist(), batch.column("v").to_pylist()):
            sums[i] = sums.get(i, 0.0) + np.frombuffer(v, np.float32).astype(np.float64)
    for i, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())],
                                         names=["part", "v"])


def averaged(model: dict[str, np.ndarray], moved: DataFrame, sparse: tuple[str, ...]) -> None:
    """Apply the average of the :func:`moves` in ``moved`` to ``model``."""
    # sorted, so sums are the same in every run
    got = moved.repartition("part").sortWithinPartitions("part", "v").mapInArrow(_add, SCHEMA).collect()  # one model's size
    total = np.zeros(sum(v.size + (len(v) if v.ndim else 1) for v in model.values()), np.float32)
    for r in got:
        total[r.part * PIECE:(r.part + 1) * PIECE] = np.frombuffer(r.v, np.float32)
    at = 0
    for k in sorted(model):
        v = model[k]
        n = len(v) if v.ndim else 1
        change, weight = total[at:at + v.size].reshape(n, -1), total[at + v.size:at + v.size + n]
        at += v.size + n
        if k not in sparse:
            weight = np.full(n, weight.max(initial=0), np.float32)
        v += (change / np.maximum(weight, 1)[:, None]).reshape(v.shape)
