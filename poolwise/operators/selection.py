"""Exact selection of the first rows of each group without a sort (E2, E4, E6,
F1, F4).

Which rows are the first ``k`` is decided by the ``k``-th value alone. It is
found by histograms: a pass counts the rows of a group in ``BINS`` equal steps
between the least and the greatest value still in question, and the bin that
holds the ``k``-th row is what the next pass looks at, between that bin's own
least and greatest value. Each pass is a partial and a final aggregate over
narrow rows, so what is shuffled are at most groups x bins counts a task. It
ends when the bin is small or holds one value; rows before it are taken as they
are, and only its own rows are ranked, by value and ties. A bin of one value
that is not small (many ties) is ranked by the two-level rank, so no task holds
it.

Groups are few (folds); their bounds are collected, a row a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, local_rows
from .ranking import rank_within

BINS = 1024
#: Rows of a group that one task may rank.
SMALL = 20_000


def _kind(x: Column, descending: bool) -> Column:
    """Where a value stands that is no finite number: Spark's order, in which
    null is the least and NaN the greatest."""
    inf = F.lit(math.inf)
    up = F.when(x.isNull(), 0).when(F.isnan(x), 4).when(x == inf, 3).when(x == -inf, 1).otherwise(2)
    return F.lit(4) - up if descending else up


def select_first(df: DataFrame, value: Column, ties: Sequence[str], by: Sequence[str] = (), k: int | None = None,
                 share: float | None = None, descending: bool = False, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """The first ``k`` rows, or the first ``floor(share x rows)``, of each ``by``
    group by ``value`` and then by the columns ``ties``, ascending. With
    ``ties`` a total order the result is that of a row number. Pass narrow rows.

    Defined cases: null and NaN values stand where Spark sorts them; -0.0 is
    0.0; a null group is a group; of rows that are equal in value and ties any
    may be taken; a group with fewer rows than asked for is taken whole."""
    if (k is None) == (share is None):
        raise ValueError("either k or share is needed")
    x, own = value.cast("double"), list(by) or ["_g"]
    kind = _kind(x, descending)
    number = F.when(kind == 2, (-x if descending else x) + 0.0).otherwise(0.0)
    rows = df.withColumn("_c", kind).withColumn("_v", number)
    rows = cut_lineage(rows if by else rows.withColumn("_g", F.lit(0)))

    of = lambda r: tuple(r[c] for c in own)
    counts: dict = {}
    found = [F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")]
    for r in rows.groupBy(*own, F.col("_c").alias("at")).agg(*found).collect():  # at most five rows a group
        counts.setdefault(of(r), []).append((r["at"], r["n"], r["lo"], r["hi"]))
    bounds, kinds = {}, {}

    def narrow(group, parts, need):
        """Keep the part that holds the group's ``need``-th row."""
        for at, n, lo, hi in sorted(parts):
            if need <= n:
                bounds[group] = (need, n, lo, hi)
                return at
            need -= n

    for group, parts in counts.items():
        n = sum(p[1] for p in parts)
        want = min(n, k if share is None else math.floor(n * share))
        if want > 0:
            kinds[group] = narrow(group, parts, want)

    schema = T.StructType([*(T.StructField(f"_b{i}", rows.schema[c].dataType) for i, c in enumerate(own)),
                           *T.StructType.fromDDL("_at int, _need long, _n long, _lo double, _hi double").fields])

    def with_bounds(groups):
        table = local_rows(rows.sparkSession, [(*g, kinds[g], *bounds[g]) for g in groups], schema)
        same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(own)]
        return rows.join(F.broadcast(table), same)  # a row a group

    while True:
        # halves, so that no difference overflows
        wide = [g for g, (need, n, lo, hi) in bounds.items() if n > small and need < n and hi / 2 - lo / 2 > 0]
        if not wide:
            break
        inside = with_bounds(wide).filter((F.col("_c") == F.col("_at")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        step = F.least(F.lit(bins - 1), F.floor(part * bins)).cast("int").alias("at")
        steps: dict = {}
        for r in inside.groupBy(*own, step).agg(*found).collect():  # at most ``bins`` rows a group
            steps.setdefault(of(r), []).append((r["at"], r["n"], r["lo"], r["hi"]))
        for group, parts in steps.items():
            narrow(group, parts, bounds[group][0])

    if not bounds:
        return df.limit(0)
    placed = with_bounds(bounds)
    mine = F.col("_c") == F.col("_at")
    at_border = mine & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    before = (F.col("_c") < F.col("_at")) | (mine & (F.col("_v") < F.col("_lo"))) | (at_border & (F.col("_need") == F.col("_n")))
    sure = placed.filter(before).select(*df.columns)
    cut = [n for need, n, _, _ in bounds.values() if need < n]
    if not cut:
        return sure
    border = placed.filter(at_border & (F.col("_need") < F.col("_n"))).select(*rows.columns, "_need")
    if max(cut) <= small:
        last = border.withColumn("_rn", F.row_number().over(Window.partitionBy(*own).orderBy("_v", *ties)))
    else:
        last = rank_within(border, [F.col("_v").asc(), *(F.col(c).asc() for c in ties)], by=own, name="_rn", groups_bounded=True)
    return sure.unionByName(last.filter("_rn <= _need").select(*df.columns))
