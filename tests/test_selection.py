"""Selection by histograms against a row number."""
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from poolwise.operators import folds
from poolwise.operators.selection import select_first

SCHEMA = "g string, id string, x double"


def _want(df, k=None, share=None, descending=False):
    order = F.col("x").desc() if descending else F.col("x").asc()
    w = Window.partitionBy("g")
    r = df.withColumn("rn", F.row_number().over(w.orderBy(order, "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    r = r.filter(F.col("rn") <= (F.lit(k) if share is None else F.floor(F.col("n") * F.lit(share))))
    return _rows(r.select("g", "id", "x"))


def _rows(df):
    return sorted(map(repr, ((r.g, r.id, r.x) for r in df.collect())))


def _mixed(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", f"v{i:04d}", float(x)) for i, x in enumerate(rng.normal(size=900) ** 5)]
    rows += [("ties", f"v{i:04d}", 0.25 if i % 3 else 0.5) for i in range(300)]
    rows += [(None, f"v{i}", float(i % 7)) for i in range(40)]
    rows += [("odd", "a", math.inf), ("odd", "b", -math.inf), ("odd", "c", math.nan), ("odd", "d", None), ("odd", "e", -0.0), ("odd", "f", 0.0),
             ("odd", "g", 1e308), ("odd", "h", -1e308), ("odd", "i", 5e-324), ("odd", "j", math.nan), ("one", "z", 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("ask", [{"k": 1}, {"k": 7}, {"k": 250}, {"share": 0.3}, {"share": 0.5, "descending": True}, {"k": 5, "descending": True}])
def test_equals_the_row_number(spark, ask):
    df = _mixed(spark)
    got = select_first(df, F.col("x"), ["id"], ["g"], bins=8, small=6, **ask)
    assert _rows(got) == _want(df, **ask)


def test_no_range_exchange_unless_ties_fill_a_bin(spark):
    df = _mixed(spark)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    usual = select_first(df, F.col("x"), ["id"], ["g"], share=0.3)
    assert "rangepartitioning" not in plan(usual) and _rows(usual) == _want(df, share=0.3)


def test_whole_groups_none_and_empty(spark):
    df = _mixed(spark)
    assert _rows(select_first(df, F.col("x"), ["id"], ["g"], k=10_000)) == _rows(df)
    assert select_first(df, F.col("x"), ["id"], ["g"], k=0).collect() == []
    assert select_first(df.limit(0), F.col("x"), ["id"], ["g"], k=3).collect() == []
    assert [r.id for r in select_first(df.filter("g = 'one'"), F.col("x"), ["id"], k=3).collect()] == ["z"]
    with pytest.raises(ValueError):
        select_first(df, F.col("x"), ["id"], ["g"])


def test_hash_selections_equal_the_hash_order(spark):
    df = spark.createDataFrame([(f, 0, f"v{i}") for f in range(3) for i in range(41 + f)], "fold int, iteration int, video_id string")
    h = folds.hash_key(7, "fold", "video_id")
    rn = F.row_number().over(Window.partitionBy("fold").orderBy(h, "video_id"))
    want = sorted(tuple(r) for r in df.withColumn("rn", rn).filter("rn <= 9").drop("rn").collect())
    assert sorted(tuple(r) for r in folds.random_sample(df, 9, 7, by=["fold"]).collect()) == want
    assert sorted(r["count"] for r in folds.drop_half(df).groupBy("fold").count().collect()) == [20, 21, 21]


def test_bounds_need_no_python_stage(spark):
    """A group's bounds are part of the plan; from a list of tuples each of them was a task for every core."""
    df = spark.createDataFrame([(i % 3, i, float(i * 7 % 50)) for i in range(60)], "g int, id int, v double")
    out = select_first(df, F.col("v"), ["id"], ["g"], k=5)
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 15
