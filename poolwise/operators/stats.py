"""Dataset statistics (D13, D14) and score de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import fabrication_fields


def fabrication_stats(items: DataFrame, by: Sequence[str] = (), id_col: str = "video_id",
                      total_label: str = "Total") -> DataFrame:
    """Generated items per fabrication type (and ``by`` columns), with a
    total row per ``by`` group (rollup): by…, fabrication_type, n."""
    by = list(by)
    typed = items.withColumn("fabrication_type", fabrication_fields(id_col)["fabrication_type"]) \
        .filter(F.col("fabrication_type").isNotNull())
    g = typed.rollup(*by, "fabrication_type").agg(F.count(F.lit(1)).alias("n"),
                                                   F.grouping_id().alias("_gid"))
    if by:  # keep per-group totals, drop the grand and partial-by totals
        g = g.filter(F.col("_gid") <= 1)
    return g.select(*by, F.coalesce("fabrication_type", F.lit(total_label)).alias("fabrication_type"),
                    "n")


def category_share(df: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """Share of each category within its group: by…, category, n, share.
    Aggregate first; the window then runs over the aggregated rows only."""
    by = list(by)
    g = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def score_share(df: DataFrame, by: Sequence[str], score: str, threshold: float = 3) -> DataFrame:
    """Share of rows scoring at least ``threshold`` per group: by…, n, share."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0)).alias("share"))


def dedup_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the row with the largest ``order`` (last write wins,
    like a dict keyed by id). ``max_by`` aggregates partially per map task."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
            .select(key, "_r.*"))
