"""Gradual shot boundaries by two thresholds.

The step between neighbouring frames is ``1 - cosine`` in millionths. A step of
at least ``high`` is a cut. Steps from ``low`` up to ``high`` in a row are a run;
a run whose sum reaches ``high`` is a gradual transition (fade, dissolve), one
that does not is movement inside a shot. A cut ends a run and stands for it.
After a boundary the next ``rest`` frames are passed over, so flashes and the end
of a dissolve do not cut again.

What a frame means hangs on the frames before it, so this is a state machine: the
frames still to rest and the run that is open. It runs on Spark as an associative
scan. Frames are ordered by range partitions. A first pass gives, for every
partition, the state it ends in for each state it may be entered in: ``rest + 1``
states without a run, and one with an open run whose sum is not known yet. The
latter can only end in two ways, by whether the sum that comes in reaches ``high``
with the steps that the partition adds to it, so a table of ``rest + 4`` states
describes a partition exactly, however many frames or keys it holds. A second
step folds these tables, a row a partition, into the state each partition is
entered in; the last pass emits the boundaries. A key with a third of all frames
is spread over every task, and vectors move once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .sequences import frame_similarity

#: Steps are counted in millionths, so that sums are exact in any order.
UNIT = 1_000_000
#: frames to rest, start and end of the open run (null: none), its sum
IDLE = (0, None, None, 0)
_STATE = "struct<wait:int,start:long,end:long,sum:long>"


def _step(state, pos, q, low, high, rest):
    """(next state, boundary or None) after the frame at ``pos``, ``q`` its step."""
    wait, start, end, total = state
    if wait:
        return (wait - 1, None, None, 0), None
    if q >= high:
        return (rest, None, None, 0), ("cut", pos, pos, q)
    if q >= low:
        return (0, pos if start is None else start, pos, total + q), None
    if start is not None and total >= high:
        return (rest, None, None, 0), ("gradual", start, end, total)
    return IDLE, None


class Summary:
    """How the frames of one key in one partition change the state. ``states``
    are the ends of the entries without a run, by frames to rest; ``added`` is
    what they add to an open run, ``upto`` where it stands, ``over`` whether it
    ends here: then ``reached`` and ``missed`` are the ends if its sum reaches
    ``high`` or not."""

    def __init__(self, low: int, high: int, rest: int):
        self.args = low, high, rest
        self.states = [(w, None, None, 0) for w in range(rest + 1)]
        self.added, self.upto, self.over, self.reached, self.missed = 0, None, False, IDLE, IDLE

    def add(self, pos: int, q: int) -> None:
        low, high, rest = self.args
        after = {s: _step(s, pos, q, *self.args)[0] for s in {*self.states, self.reached, self.missed}}
        self.states = [after[s] for s in self.states]
        if self.over:
            self.reached, self.missed = after[self.reached], after[self.missed]
        elif low <= q < high:
            self.added, self.upto = self.added + q, pos
        else:
            self.over, self.reached = True, (rest, None, None, 0)
            self.missed = self.reached if q >= high else IDLE

    def apply(self, state) -> tuple:
        """The state behind these frames when they are entered in ``state``."""
        wait, start, end, total = state
        if start is None:
            return self.states[wait]
        if not self.over:
            return (0, start, end if self.upto is None else self.upto, total + self.added)
        return self.reached if total + self.added >= self.args[1] else self.missed


def _rows(batches):
    """(partition, key, position, step) of a stream of Arrow batches."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("_pid", "_key", "_pos", "_q")))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def shot_transitions(seq: DataFrame, low: float, high: float, rest: int = 3, key: str = "key", pos: str = "pos",
                     vec: str = "vec") -> DataFrame:
    """The shot boundaries of every key: key, kind (``cut`` or ``gradual``),
    start_pos and end_pos (its first and last frame), strength (the sum of its
    steps). ``low`` and ``high`` are steps of ``1 - cosine``.

    Defined cases: a key's first frame is no boundary; a run still open at the
    key's last frame counts if its sum reaches ``high``; a null key is a key of
    its own; a step that is null or not a number (a missing or broken vector) is
    the largest, a cut; positions need not be dense; frames of one (key, pos)
    follow in no defined order; no frames, no rows."""
    if not 0 < low <= high or rest < 0:
        raise ValueError("0 < low <= high and rest >= 0 are needed")
    low, high = round(low * UNIT), round(high * UNIT)
    kind = seq.schema[key].dataType
    near = frame_similarity(seq, key, pos, vec)
    step = F.when(F.col("_head"), 0).when(F.col("_near").isNull() | F.isnan("_near"), 2 * UNIT).otherwise(F.round((1 - F.col("_near")) * UNIT))
    steps = cut_lineage(near.select("_pid", F.col(key).alias("_key"), F.col(pos).cast("long").alias("_pos"), step.cast("long").alias("_q")))
    firsts = steps.groupBy("_pid").agg(F.min(F.struct("_key", "_pos")).alias("first"), F.max(F.struct("_key", "_pos")).alias("last"))
    firsts = firsts.select("_pid", F.col("first._key").alias("first"), F.col("last._key").alias("last"))
    laid = steps.repartition("_pid").sortWithinPartitions("_pid", F.col("_key").asc_nulls_first(), "_pos")

    # 1. one table of states a partition: what its last key's frames do
    table = T.StructType.fromDDL(f"_pid int, states array<{_STATE}>, added long, upto long, over boolean, reached {_STATE}, missed {_STATE}")
    arrow = to_arrow_schema(table)

    def summed(batches):
        at, name, one, out = None, None, None, []

        def row():
            state = lambda s: dict(zip(("wait", "start", "end", "sum"), s))
            return at, [state(s) for s in one.states], one.added, one.upto, one.over, state(one.reached), state(one.missed)

        for pid, own, p, q in _rows(batches):
            if pid != at or own != name:
                if at is not None and pid != at:
                    out.append(row())
                at, name, one = pid, own, Summary(low, high, rest)
            one.add(p, q)
        if at is not None:
            out.append(row())
        yield _batch(out, arrow)

    tables = laid.mapInArrow(summed, table).join(firsts, "_pid")

    # 2. fold the tables, a row a partition
    entered = T.StructType.fromDDL(f"_pid int, entry {_STATE}, ends boolean")
    entered_arrow = to_arrow_schema(entered)

    def folded(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_pid"])
        out, state, before = [], IDLE, None
        of = lambda d: (d["wait"], d["start"], d["end"], d["sum"])
        for i, r in enumerate(rows):
            if before is None or before["last"] != r["first"]:
                state = IDLE
            after = rows[i + 1] if i + 1 < len(rows) else None
            out.append((r["_pid"], dict(zip(("wait", "start", "end", "sum"), state)), after is None or after["first"] != r["last"]))
            if r["first"] != r["last"]:
                state = IDLE  # the last key begins here
            one = Summary(low, high, rest)
            one.states, one.added, one.upto, one.over = [of(s) for s in r["states"]], r["added"], r["upto"], r["over"]
            one.reached, one.missed = of(r["reached"]), of(r["missed"])
            state, before = one.apply(state), r
        return pa.Table.from_batches([_batch(out, entered_arrow)])

    entries = cut_lineage(tables.groupBy(F.lit(0).alias("_all")).applyInArrow(folded, entered))  # a few numbers a partition

    # 3. the boundaries
    found = T.StructType([T.StructField("_key", kind), *T.StructType.fromDDL("kind string, start_pos long, end_pos long, strength long").fields])
    found_arrow = to_arrow_schema(found)
    first_rows = entries.select("_pid", F.lit(None).cast(kind).alias("_key"), F.lit(None).cast("long").alias("_pos"), F.lit(None).cast("long").alias("_q"),
                                "entry", "ends")
    none = [F.lit(None).cast(entered[c].dataType).alias(c) for c in ("entry", "ends")]
    both = steps.select("*", *none).unionByName(first_rows).repartition("_pid").sortWithinPartitions(
        "_pid", F.col("entry").isNull(), F.col("_key").asc_nulls_first(), "_pos")

    def emitted(batches):
        state, name, ends, fresh, out = IDLE, None, True, True, []

        def close():
            if state[1] is not None and state[3] >= high:
                out.append((name, "gradual", *state[1:]))

        for batch in batches:
            for own, p, q, entry, last in zip(*(batch.column(c).to_pylist() for c in ("_key", "_pos", "_q", "entry", "ends"))):
                if entry is not None:  # a partition begins
                    if ends and not fresh:
                        close()
                    state, ends, fresh = (entry["wait"], entry["start"], entry["end"], entry["sum"]), last, True
                    continue
                if not fresh and own != name:
                    close()
                    state = IDLE
                name, fresh = own, False
                state, got = _step(state, p, q, low, high, rest)
                if got is not None:
                    out.append((name, *got))
            if len(out) >= 10_000:
                yield _batch(out, found_arrow)
                out.clear()
        if ends and not fresh:
            close()
        yield _batch(out, found_arrow)

    out = both.mapInArrow(emitted, found)
    return out.select(F.col("_key").alias(key), "kind", "start_pos", "end_pos", "strength")
