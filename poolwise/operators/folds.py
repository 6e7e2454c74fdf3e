"""Seeded folds, orders and samples.

Randomness is a keyed hash, ``md5('<seed>:<…>:<id>')``, so every engine and
every re-run (also after a lost executor) gives the same order. It has the
distribution of a shuffle, not Python's Mersenne-Twister sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ntile_of_rank, rank_within
from .selection import select_first

DEFAULT_SEED = 2025


def hash_key(seed: int, *parts) -> Column:
    """``md5('<seed>:<part>:…')`` as the ordering key."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*pieces))


def kfold(ids: DataFrame, k: int = 5, seed: int = DEFAULT_SEED, id_col: str = "video_id",
          fold_col: str = "fold") -> DataFrame:
    """Assign each id to one of ``k`` folds: seeded shuffle, then contiguous
    chunks with the first ``n % k`` one larger (equals ``ntile(k)`` over the
    shuffled order). Uses the two-level rank, never a single-task window."""
    keyed = ids.select(id_col).withColumn("_h", hash_key(seed, id_col))
    ranked = rank_within(keyed, [F.col("_h").asc(), F.col(id_col).asc()],
                         name="_r", size_name="_n")
    return ranked.select(id_col, ntile_of_rank(F.col("_r"), F.col("_n"), k).alias(fold_col))


def fold_roles(folds: DataFrame, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """Every id once per fold run: ``val`` in its own fold, ``train`` in the
    other ``k - 1``. A bounded ``k``-way explode, no join."""
    return (folds.withColumn("run_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("role", F.when(F.col("run_fold") == F.col(fold_col), F.lit("val"))
                        .otherwise(F.lit("train"))))


def seeded_order(df: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "video_id",
                 name: str = "ord") -> DataFrame:
    """Global 1-based position of each row in the seeded shuffle."""
    keyed = df.withColumn("_h", hash_key(seed, id_col))
    return rank_within(keyed, [F.col("_h").asc(), F.col(id_col).asc()], name=name).drop("_h")


def random_sample(df: DataFrame, n: int, seed: int = DEFAULT_SEED, id_col: str = "video_id",
                  by: Sequence[str] = ()) -> DataFrame:
    """Random-selection baseline: the first ``n`` rows of the seeded shuffle
    (per ``by`` group when given). Globally a top-n (TakeOrderedAndProject);
    per group a selection by histograms, since ``n`` may be a share of the pool
    and groups are few; pass narrow rows."""
    keyed = df.withColumn("_h", hash_key(seed, *by, id_col))
    if not by:
        return keyed.orderBy("_h", id_col).limit(n).drop("_h")
    return select_first(keyed, _leading(F.col("_h")), ["_h", id_col], by, k=n).select(*df.columns)


def _leading(h: Column) -> Column:
    """The first 52 bits of a hexadecimal hash, as a number of the same order."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double")


def drop_half(selected: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "video_id",
              by: Sequence[str] = ("fold", "iteration")) -> DataFrame:
    """A seeded ``len // 2`` of each group's selection (which may be a share of
    the pool), chosen by histograms of the hash."""
    keyed = selected.withColumn("_h", hash_key(seed, *by, id_col))
    return select_first(keyed, _leading(F.col("_h")), ["_h", id_col], by, share=0.5).select(*selected.columns)
