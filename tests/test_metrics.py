import math

import pytest

from poolwise.operators import metrics as me
from poolwise.operators.metrics import (auc_scores, binary_metrics, classification_report,
                                        confusion_matrix, mean_log_loss)


def _ref(y, p):
    labels = sorted(set(y) | set(p))
    f1s, precs, recs = [], [], []
    for c in labels:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        fp = sum(1 for a, b in zip(y, p) if a != c and b == c)
        fn = sum(1 for a, b in zip(y, p) if a == c and b != c)
        precs.append(tp / (tp + fp) if tp + fp else 0.0)
        recs.append(tp / (tp + fn) if tp + fn else 0.0)
        f1s.append(2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)
    m = lambda v: sum(v) / len(v)
    acc = sum(1 for a, b in zip(y, p) if a == b) / len(y)
    return acc, m(precs), m(recs), m(f1s)


def test_binary_metrics_against_reference_formulas(spark):
    cases = {"a": ([0, 0, 1, 1, 1, 0, 1], [0, 1, 1, 1, 0, 0, 1]),
             "one_class": ([1, 1, 1], [1, 1, 1]),
             "pred_only": ([1, 1, 1, 1], [0, 1, 1, 0])}
    rows = [(g, a, b) for g, (ys, ps) in cases.items() for a, b in zip(ys, ps)]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    got = {r.g: r for r in binary_metrics(df, keys=["g"]).collect()}
    for g, (ys, ps) in cases.items():
        acc, pr, rc, f1 = _ref(ys, ps)
        r = got[g]
        assert math.isclose(r.acc, acc) and math.isclose(r.precision, pr)
        assert math.isclose(r.recall, rc) and math.isclose(r.f1, f1)
    # AUC of hard labels = mean of the recalls; undefined with one class in y
    assert got["one_class"].auc is None and got["pred_only"].auc is None
    r0, r1 = 2 / 3, 3 / 4
    assert math.isclose(got["a"].auc, (r0 + r1) / 2)


def test_auc_scores_ties_and_half_even_rounding(spark):
    y = [0, 0, 1, 1, 0, 1]
    s = [0.1, 0.5, 0.5, 0.9, 0.5, 0.7]
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    r = auc_scores(df).collect()[0]
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    ref = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(r.auc, ref)
    # round half to even: 0.5 -> 0
    acc, *_ = _ref(y, [0, 0, 0, 1, 0, 1])
    assert math.isclose(r.acc, acc)


def test_a_third_class_counts(spark):
    y, s = [1, 1, 0, 0], [0.9, 1.6, 0.2, 0.4]  # 1.6 rounds to class 2
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    r = auc_scores(df).first()
    acc, pr, rc, f1 = _ref(y, [1, 2, 0, 0])
    assert r.n == 4 and math.isclose(r.acc, 0.75) and math.isclose(r.precision, pr)
    assert math.isclose(r.recall, rc) and math.isclose(r.f1, f1) and math.isclose(acc, 0.75)
    with pytest.raises(Exception, match="not a binary label"):
        binary_metrics(df.withColumn("p", df.y + 1)).collect()


def test_auc_with_one_hot_score(spark):
    """Nine rows in ten share a score: it is one level."""
    rows = [(i % 2, 0.5) for i in range(900)] + [(i % 3 == 0, i / 100) for i in range(100)]
    rows = [(int(a), float(b)) for a, b in rows]
    r = auc_scores(spark.createDataFrame(rows, "y int, score double").repartition(4)).first()
    pos, neg = [b for a, b in rows if a], [b for a, b in rows if not a]
    ref = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(r.auc, ref)


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    cm = sorted(tuple(r) for r in confusion_matrix(df).collect())
    assert cm == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 0)]
    rep = {r.label: r for r in classification_report(df).collect()}
    assert rep["real"].precision == round(2 / 3, 4) and rep["real"].support == 2
    assert rep["fake"].f1 == 0.0 and rep["accuracy"].f1 == round(2 / 3, 4)
    assert rep["macro avg"].recall == 0.5


def test_mean_log_loss(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([0.0, 0.0], 0)], "logits array<double>, y int")
    r = mean_log_loss(df).collect()[0]
    ref = ((math.log(math.exp(1) + math.exp(2)) - 2) + math.log(2)) / 2
    assert math.isclose(r.log_loss, ref)


def test_report_counts_rows_of_a_third_class(spark):
    """Rows (0,0) (1,1) (2,1) (1,2): half of the four are right."""
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (1, 2)], "y int, p int")
    got = {r.label: r for r in me.classification_report(df).collect()}
    assert (got["accuracy"].f1, got["accuracy"].support) == (0.5, 4)
    assert (got["fake"].precision, got["fake"].recall, got["fake"].support) == (0.5, 0.5, 2)
    assert got["outside"].support == 2
    plain = me.classification_report(df.filter("y < 2 AND p < 2"))
    assert "outside" not in {r.label for r in plain.collect()}
    with pytest.raises(Exception, match="not a binary label"):
        me.confusion_matrix(df).collect()
    nulls = spark.createDataFrame([(0, 0), (None, 1), (1, None)], "y int, p int")
    assert {r.label: r.support for r in me.classification_report(nulls).collect()}["outside"] == 2
