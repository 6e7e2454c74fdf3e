"""Item-set operators: pool filter, restriction, labels, exclusion, unions,
quality gate (B1-B4, C8, G1-G4, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import REAL_VALUES, encode_label as _encode, seed_id


def generated_pool(items: DataFrame, exclude_seed_ids: DataFrame | None = None,
                   id_col: str = "video_id", source_col: str = "source",
                   human_value: str = "Human") -> DataFrame:
    """Generated items (source is not ``Human``; a NULL source counts as
    generated) whose seed id is not in ``exclude_seed_ids``.

    Anti join on the seed id: a hash anti join, never an ``isin`` list."""
    pool = items.filter(~F.col(source_col).eqNullSafe(F.lit(human_value)))
    if exclude_seed_ids is None:
        return pool
    seeds = exclude_seed_ids.select(F.col(exclude_seed_ids.columns[0]).alias("_seed")) \
        .filter(F.col("_seed").isNotNull()).distinct()
    return (pool.withColumn("_seed_of", seed_id(id_col))
            .join(seeds, F.col("_seed_of") == F.col("_seed"), "left_anti")
            .drop("_seed_of"))


def restrict(items: DataFrame, ids: DataFrame, id_col: str = "video_id") -> DataFrame:
    """Items whose id is in ``ids``. Multiplicity follows ``items`` (semi join)."""
    keys = ids.select(F.col(ids.columns[0]).alias(id_col))
    return items.join(keys, id_col, "left_semi")


def encode_label(items: DataFrame, dataset: str = "fakett", label_col: str = "label",
                 out_col: str = "y", real_value: str | None = None) -> DataFrame:
    rv = real_value if real_value is not None else REAL_VALUES[dataset]
    return items.withColumn(out_col, _encode(label_col, rv))


def candidates(pool: DataFrame, state: DataFrame, keys=("fold", "video_id")) -> DataFrame:
    """Pool rows not yet marked useful or useless for their fold. Anti join
    keeps pool order-free duplicates (``EXCEPT`` would drop them)."""
    keys = list(keys)
    return pool.join(state.select(*keys).distinct(), keys, "left_anti")


def train_set(base: DataFrame, selected: DataFrame) -> DataFrame:
    """Bag union (list concatenation) of two id sets with the same columns."""
    return base.unionByName(selected)


def quality_gate(items: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep items with a label row saying quality 1 and not toxic."""
    ok = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select(id_col)
    return items.join(ok, id_col, "left_semi")


def pool_counters(state: DataFrame, by=("fold",)) -> DataFrame:
    return state.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
