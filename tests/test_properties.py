"""Property tests; few examples each, every example is a Spark job."""
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolwise.operators.folds import kfold
from poolwise.operators.metrics import binary_metrics
from poolwise.operators.sequences import stride_sample
from poolwise.operators.training import with_prediction

SETTINGS = settings(max_examples=6, deadline=None, derandomize=True)


@SETTINGS
@given(lens=st.lists(st.integers(1, 60), min_size=1, max_size=4), L=st.integers(1, 20))
def test_stride_sample_emits_min_n_L(spark, lens, L):
    rows = [(f"k{i}", p, float(p)) for i, n in enumerate(lens) for p in range(n)]
    out = stride_sample(spark.createDataFrame(rows, "key string, pos int, x double"), L)
    got = {r["key"]: r["count"] for r in out.groupBy("key").count().collect()}
    assert got == {f"k{i}": min(n, L) for i, n in enumerate(lens)}


@SETTINGS
@given(n=st.integers(1, 80), k=st.integers(2, 7))
def test_kfold_sizes_differ_by_at_most_one(spark, n, k):
    ids = spark.createDataFrame([(f"id{i}",) for i in range(n)], "video_id string")
    sizes = [r["count"] for r in kfold(ids, k).groupBy("fold").count().collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and len(sizes) == min(n, k)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=2, max_size=40))
def test_hard_label_auc_is_macro_recall(spark, pairs):
    df = spark.createDataFrame(pairs, "y int, p int")
    r = binary_metrics(df).collect()[0]
    ys = {y for y, _ in pairs}
    if ys != {0, 1}:
        assert r.auc is None
    else:
        rec = [sum(1 for y, p in pairs if y == c and p == c) / sum(1 for y, _ in pairs if y == c) for c in (0, 1)]
        assert math.isclose(r.auc, sum(rec) / 2)


@SETTINGS
@given(logits=st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=1, max_size=20))
def test_entropy_bounds(spark, logits):
    df = spark.createDataFrame([([a, b],) for a, b in logits], "logits array<double>")
    for r in with_prediction(df).collect():
        assert -1e-9 <= r.entropy <= math.log(2) + 1e-9
        assert r.pred == (1 if r.logits[1] > r.logits[0] else 0)
