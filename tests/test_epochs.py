"""The head with epochs against a plain numpy version, and its early stop."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.operators import epochs as ep
from poolwise.operators.metrics import binary_metrics
from poolwise.operators.training import early_stop
from poolwise.plans import active_learning as al
from test_active_learning import _tiny


def _data(n=120, d=4, k=3, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) + 0.7 * (2 * y[:, None] - 1) * rng.normal(size=d)
    return x, y, rng.integers(0, k, n)


def _plain(x, y, fold, start, params):
    """Every fold on its own, an epoch at a time."""
    best, history = start.copy(), []
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for f in range(len(start)):
        w, best_f1, best_epoch = start[f].copy(), 0.0, 0
        tr, va = fold != f, fold == f
        for epoch in range(1, params.epochs + 1):
            z = x1[tr] @ w.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            loss = -np.log(p[np.arange(tr.sum()), y[tr]]).mean()
            p[np.arange(tr.sum()), y[tr]] -= 1
            g = p.T @ x1[tr] / tr.sum()
            g *= min(1.0, params.clip / (np.linalg.norm(g) + 1e-6))
            w = w - params.lr * (g + params.weight_decay * w)
            pred = (x1[va] @ w.T).argmax(axis=1)
            f1 = ep.macro_f1([((y[va] == a) & (pred == b)).sum() for a in (0, 1) for b in (0, 1)])
            history.append((f, epoch, loss, f1))
            if f1 > best_f1:
                best_f1, best_epoch, best[f] = f1, epoch, w
            elif epoch - best_epoch >= params.patience:
                break
    return best, history


def _rows(spark, x, y, fold, k):
    train = spark.createDataFrame([(int(f), int(c), [float(v) for v in r]) for f, c, r in zip(fold, y, x)], "fold int, y int, fea array<double>")
    return train, ep.training_rows(train, k)


@pytest.mark.parametrize("lr,patience,decay", [(0.3, 4, 0.0), (5.0, 2, 0.01), (0.05, 1, 0.0)])
def test_epochs_match_a_plain_fit(spark, lr, patience, decay):
    x, y, fold = _data()
    params = ep.EpochParams(epochs=8, lr=lr, patience=patience, weight_decay=decay)
    start = np.zeros((3, 2, 5))
    want, history = _plain(x, y, fold, start, params)
    got, seen = ep.fit_epochs(_rows(spark, x, y, fold, 3)[1], start, params)
    assert np.allclose(got, want, atol=1e-10)
    assert [(h[0], h[1]) for h in sorted(seen)] == [(h[0], h[1]) for h in sorted(history)]
    assert np.allclose([h[2:] for h in sorted(seen)], [h[2:] for h in sorted(history)])
    table = spark.createDataFrame(seen, "run_id int, epoch int, loss double, f1 double")
    for r in early_stop(table, patience, params.threshold).collect():
        mine = [h for h in history if h[0] == r.run_id]
        assert r.stop_epoch == mine[-1][1] and r.best_f1 == pytest.approx(max(h[3] for h in mine))


def test_layout_does_not_matter(spark):
    x, y, fold = _data()
    params = ep.EpochParams(epochs=3)
    rows = _rows(spark, x, y, fold, 3)[1]
    one, _ = ep.fit_epochs(rows.repartition(1), np.zeros((3, 2, 5)), params)
    many, _ = ep.fit_epochs(rows.repartition(7), np.zeros((3, 2, 5)), params)
    assert np.allclose(one, many, atol=1e-12)


def test_a_pass_counts_members_of_the_pool(spark):
    x, y, fold = _data(30)
    train, _ = _rows(spark, x, y, fold, 3)
    pool = spark.createDataFrame([("a", 1, [1.0] * 4), ("a", 0, [2.0] * 4), ("b", 1, [0.0] * 4)], "video_id string, y int, fea array<double>")
    members = spark.createDataFrame([(0, "a"), (2, "a"), (2, "b"), (2, "b")], "fold int, video_id string")
    sums = ep.fold_sums(ep.training_rows(train, 3, pool, members), np.zeros((3, 2, 5)))
    n = [int(sums[f][11]) for f in range(3)]
    assert n == [int((fold != 0).sum()) + 2, int((fold != 1).sum()), int((fold != 2).sum()) + 3]
    assert all(sums[f][12:].sum() == (fold == f).sum() for f in range(3))


def test_bad_input(spark):
    with pytest.raises(ValueError):
        ep.EpochParams(lr=0)
    rows = spark.createDataFrame([([0], -1, 1, [1.0, 2.0]), ([0], -1, 0, [1.0])], "runs array<int>, val int, y int, fea array<double>").coalesce(1)
    with pytest.raises(Exception, match="several widths"):
        ep.fold_sums(rows, np.zeros((1, 2, 3)))
    with pytest.raises(ValueError, match="bytes"):
        ep.fold_sums(rows, np.zeros((1, 2, ep.MAX_WEIGHT_BYTES // 16 + 1)))
    empty, history = ep.fit_epochs(rows.limit(0), np.ones((1, 2, 3)), ep.EpochParams())
    assert history == [] and (empty == 1).all()


def test_loop_and_final_fit_under_the_softmax_head(spark, tmpdir_path):
    """The whole run with epochs, ended after a round and resumed."""
    items, train_ids = _tiny(spark, 12)
    cfg = al.ALConfig(rounds=3, pool_size=3, k_folds=2, min_votes=1)
    params = ep.EpochParams(epochs=3, lr=1.0)
    prepared = lambda: al.prepare(items, train_ids, train_ids.limit(6), None, cfg, al.SoftmaxHead(params))
    data = prepared()
    val = data.test.select("video_id", "y", "fea")
    whole = al.cross_validated_selection(data, cfg, val)
    al.al_loop(prepared(), cfg, rounds=1, state_dir=tmpdir_path + "/al")
    again = al.cross_validated_selection(prepared(), cfg, val, state_dir=tmpdir_path + "/al", accepted_path=tmpdir_path + "/accepted")
    norm = lambda out: sorted(map(tuple, out["state"].collect()))
    assert norm(whole) == norm(again)
    assert whole["test_metrics"].collect() == again["test_metrics"].collect() == again["val_metrics"].collect()
    assert len(data.head.histories) == 1 + 3 + 1  # first fit, rounds, final fit


def test_scores_of_the_softmax_head(spark):
    items, train_ids = _tiny(spark, 8)
    cfg = al.ALConfig(rounds=1, pool_size=2, k_folds=2)
    data = al.prepare(items, train_ids, train_ids, None, cfg, al.SoftmaxHead(ep.EpochParams(epochs=2)))
    w = ep.weights_array(data.init_sums)
    rows = data.train.collect()
    got = {(r.fold, r.video_id): r.pred for r in al.val_scores(data, data.init_sums).collect()}
    for r in rows:
        assert got[(r.fold, r.video_id)] == int((w[r.fold] @ [*r.fea, 1.0]).argmax())
    every = data.head.predict_all(data.init_sums, data.test)
    assert every.count() == 2 * data.test.count()
    assert binary_metrics(every, "y", "pred", ["fold"]).filter(F.col("n") > 0).count() == 2
