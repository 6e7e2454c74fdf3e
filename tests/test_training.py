import math

import numpy as np
from pyspark.sql import functions as F

from poolwise.operators.training import (add_sums, class_sums, early_stop, fit_centroids, kfold_sums,
                                         score_centroids)


def test_centroids_and_kfold_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(int(f), f"v{i}", int(y), [float(v) for v in rng.normal(size=3)])
            for i, (f, y) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 2, 40)))]
    df = spark.createDataFrame(rows, "fold int, video_id string, y int, fea array<double>")
    ks = {(r.fold, r.y): (r.n, r.vsum) for r in kfold_sums(df, 3).collect()}
    for f in range(3):
        for y in range(2):
            sel = [np.array(x) for (ff, _, yy, x) in rows if ff != f and yy == y]
            n, v = ks[(f, y)]
            assert n == len(sel) and np.allclose(v, np.sum(sel, axis=0))
    c = {r.y: r.centroid for r in fit_centroids(df).collect()}
    assert np.allclose(c[1], np.mean([x for (_, _, yy, x) in rows if yy == 1], axis=0))
    both = add_sums(class_sums(df), class_sums(df)).collect()
    assert all(r.n == 2 * sum(1 for row in rows if row[2] == r.y) for r in both)


def test_score_centroids_entropy_and_ties(spark):
    model = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "y int, centroid array<double>")
    df = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [0.0, 2.0])], "video_id string, fea array<double>")
    got = {r.video_id: r for r in score_centroids(model, df, scale=10.0).collect()}
    assert got["a"].pred == 0  # tie -> lowest class
    assert math.isclose(got["a"].entropy, -2 * 0.5 * math.log(0.5 + 1e-10))
    assert got["b"].pred == 1 and got["b"].logits == [0.0, 20.0]


def _ref_early_stop(f1s, patience, thr):
    best, best_ep = 0.0, 0
    for i, f in enumerate(f1s):
        if f > best:
            best, best_ep = f, i + 1
        elif i - best_ep >= patience - 1:
            return i + 1, best_ep, best, best > thr, True
    return len(f1s), best_ep, best, best > thr, False


def test_early_stop_matches_loop(spark):
    runs = {1: [0.5, 0.6, 0.7, 0.65, 0.64, 0.63, 0.62, 0.61, 0.9],
            2: [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
            3: [0.1, 0.2, 0.3],
            4: [0.7, 0.7, 0.7, 0.7, 0.7, 0.71, 0.5]}
    rows = [(r, e + 1, f) for r, fs in runs.items() for e, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, f1 double")
    got = {r.run_id: (r.stop_epoch, r.best_epoch, r.best_f1, r.is_final, r.stopped)
           for r in early_stop(df, patience=5, threshold=0.6).collect()}
    for r, fs in runs.items():
        assert got[r] == _ref_early_stop(fs, 5, 0.6), r


class _Linear:
    def __init__(self, w, b):
        self.w, self.b = np.asarray(w), np.asarray(b)

    def predict(self, x):
        return x @ self.w.T + self.b


def test_score_with_user_model_matches_linear_head(spark):
    from poolwise.operators.training import linear_scores, score_with
    w, b = [[0.5, -1.0, 2.0], [1.5, 0.25, -0.75]], [0.1, -0.2]
    df = spark.createDataFrame([(f"v{i}", [float(i), 1.0 - i, 0.5 * i]) for i in range(9)],
                               "video_id string, fea array<double>")
    weights = spark.createDataFrame([(c, w[c], b[c]) for c in (0, 1)], "cls int, w array<double>, b double")
    a = {r.video_id: r.logits for r in score_with(df, _Linear(w, b)).collect()}
    ref = {r.video_id: r.logits for r in linear_scores(df, weights).collect()}
    assert a.keys() == ref.keys()
    assert all(np.allclose(a[k], ref[k]) for k in a)
