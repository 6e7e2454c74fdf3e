"""Scalable ranks.

An unpartitioned ``Window`` (``row_number() OVER (ORDER BY …)``) moves every
row into one task; a window partitioned by a handful of folds moves a fifth of
the data into each of five tasks. Both break at scale. The two-level rank
below keeps the work spread out:

1. range-partition on ``(group…, order…)`` and sort inside each partition
   (one shuffle, balanced by Spark's sampled range bounds);
2. tag rows with their partition and position inside it
   (``monotonically_increasing_id`` is ``partition << 33 | index``);
3. count rows per ``(partition, group)`` – at most ``partitions + groups - 1``
   rows – and turn the counts into offsets;
4. rank = offset + position − first position of the group in the partition.

The tagged rows are checkpointed before the counts are taken, so counts and
positions come from one computation even if executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def rank_within(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (),
                name: str = "rank", size_name: str | None = None,
                num_partitions: int | None = None, groups_bounded: bool | None = None) -> DataFrame:
    """Add a 1-based rank (``row_number`` semantics) of each row within its
    ``by`` group, ordered by ``order``. ``order`` must be a total order (end
    it with a unique key). ``size_name`` also attaches the group size.

    The tagged rows (narrow: the caller passes only keys and ids) are
    written once to the reliable checkpoint folder, so the counts and the
    positions are read from the same materialised rows. (Two reads of an
    unmaterialised range shuffle may sample different range bounds.) The
    statistics table has at most ``partitions + groups - 1`` rows; it is
    broadcast when the number of groups is known to be small
    (``groups_bounded``; default: only when ``by`` is empty), otherwise AQE
    chooses the join from its measured size."""
    by = list(by)
    keys = [F.col(b).asc_nulls_first() for b in by] + list(order)
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    pid = F.spark_partition_id()
    tagged = (ranged.sortWithinPartitions(*keys)
              .withColumn("_pid", pid)
              .withColumn("_loc", F.monotonically_increasing_id()
                          - F.shiftleft(pid.cast("long"), 33)))
    tagged = cut_lineage(tagged)

    stats = tagged.groupBy("_pid", *by).agg(F.min("_loc").alias("_first"),
                                            F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
    if size_name:
        stats = stats.withColumn(size_name, F.sum("_n").over(Window.partitionBy(*by)))
    renamed = {b: f"_by{i}" for i, b in enumerate(by)}
    stats = stats.select(F.col("_pid").alias("_spid"),
                         *[F.col(b).alias(r) for b, r in renamed.items()],
                         "_first", "_off", *([size_name] if size_name else []))

    small = (not by) if groups_bounded is None else groups_bounded
    right = F.broadcast(stats) if small else stats
    cond = [F.col("_pid") == F.col("_spid")] + [F.col(b).eqNullSafe(F.col(r)) for b, r in renamed.items()]
    out = tagged.join(right, cond, "inner")
    out = out.withColumn(name, F.col("_off") + F.col("_loc") - F.col("_first") + 1)
    return out.drop("_pid", "_loc", "_spid", "_first", "_off", *renamed.values())


def ntile_of_rank(rank: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` from a 1-based rank and the group size: contiguous chunks,
    the first ``n % k`` one row larger (0-based bucket number)."""
    r = rank - 1
    q = F.floor(n / k).cast("long")
    rem = n - q * k
    big = rem * (q + 1)
    return (F.when(r < big, F.floor(r / (q + 1)))
            .otherwise(rem + F.floor((r - big) / F.greatest(q, F.lit(1))))).cast("int")


def totals_before(df: DataFrame, order: Sequence[Column], values: Sequence[str], by: Sequence[str] = (),
                  prefix: str = "before_") -> DataFrame:
    """Per row, the sum of each of ``values`` over the rows that come before it
    in its ``by`` group: running sums inside range partitions, plus the totals
    of the partitions before. ``order`` must be a total order."""
    by, values = list(by), list(values)
    keys = [F.col(b).asc_nulls_first() for b in by] + list(order)
    tagged = cut_lineage(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = tagged.groupBy("_pid", *by).agg(*[F.sum(v).alias(v) for v in values])
    stats = stats.select(F.col("_pid").alias("_spid"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)],
                         *[F.coalesce(F.sum(v).over(prior), F.lit(0)).alias(f"_off_{v}") for v in values])
    cond = [F.col("_pid") == F.col("_spid")] + [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    runs = tagged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    out = runs.join(stats, cond, "inner")
    return out.select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in values])
