import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.operators import similarity
from poolwise.operators.similarity import max_similarity, top_fraction, topk


def _ref(pool, anchors):
    out = {}
    for (g, pid, x) in pool:
        best = -1.0
        for (ga, a) in anchors:
            if ga != g:
                continue
            den = max(math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in a)), 1e-8)
            c = sum(u * v for u, v in zip(x, a)) / den
            if c > best:  # NaN never wins
                best = c
        out[(g, pid)] = best
    return out


@pytest.mark.parametrize("spread,block", [(None, 2 << 20), (3, 1), (1, 1)])
def test_max_similarity_matches_brute_force(spark, spread, block):
    rng = np.random.default_rng(3)
    pool = [(int(g), f"p{i}", [float(v) for v in rng.normal(size=4)]) for i, g in enumerate(rng.integers(0, 3, 60))]
    pool.append((0, "zero", [0.0, 0.0, 0.0, 0.0]))
    pool.append((2, "nan", [float("nan"), 1.0, 0.0, 0.0]))
    anchors = [(int(g), [float(v) for v in rng.normal(size=4)]) for g in rng.integers(0, 2, 9)]  # group 2 has none
    pdf = spark.createDataFrame(pool, "fold int, video_id string, fea array<double>")
    adf = spark.createDataFrame(anchors, "fold int, fea array<double>")
    got = {(r.fold, r.video_id): r.similarity
           for r in max_similarity(pdf, adf, by=["fold"], spread=spread, block_bytes=block).collect()}
    ref = _ref(pool, anchors)
    assert got.keys() == ref.keys()
    for k in ref:
        assert math.isclose(got[k], ref[k], abs_tol=1e-9), k
    assert got[(2, "nan")] == -1.0 and got[(0, "zero")] == 0.0


def test_topk_and_fraction(spark):
    df = spark.createDataFrame([(g, f"v{i}", float(i % 7)) for g in range(2) for i in range(10 + g)],
                               "fold int, video_id string, s double")
    t = topk(df, 3, [F.col("s").desc(), F.col("video_id")], by=["fold"])
    assert t.count() == 6
    f = top_fraction(df, 0.3, [F.col("s").desc(), F.col("video_id")], by=["fold"])
    got = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert got == {0: 3, 1: 3}  # int(10*0.3)=3, int(11*0.3)=3
    small = top_fraction(df.filter("video_id IN ('v1','v2','v3')"), 0.3, [F.col("s").desc(), F.col("video_id")],
                         by=["fold"])
    assert small.count() == 0  # fewer than 4 ids -> no anchors


def test_many_blocks_and_open_lists(spark):
    """Many blocks on both sides: same result, same plan; a pool row is packed
    once whatever the number of groups it is open in."""
    rng = np.random.default_rng(5)
    pool = [(f"p{i}", [g for g in range(3) if rng.random() < 0.7], [float(v) for v in rng.normal(size=3)]) for i in range(150)]
    anchors = [(int(g), [float(v) for v in rng.normal(size=3)]) for g in rng.integers(0, 3, 120)]
    pdf = spark.createDataFrame(pool, "video_id string, open array<int>, fea array<double>")
    adf = spark.createDataFrame(anchors, "fold int, fea array<double>")
    ref = _ref([(g, i, x) for i, o, x in pool for g in o], anchors)
    plans = set()
    for block in (1, 2 << 20):
        df = max_similarity(pdf, adf, by=["fold"], open_col="open", block_bytes=block)
        got = {(r.fold, r.video_id): r.similarity for r in df.collect()}
        assert got.keys() == ref.keys() and all(math.isclose(got[k], ref[k], abs_tol=1e-9) for k in ref)
        text = df._jdf.queryExecution().optimizedPlan().toString()
        plans.add(tuple(line.strip(" :+-").split(" ")[0] for line in text.splitlines()))
    assert len(plans) == 1


def test_missing_vector_is_an_error(spark):
    pool = spark.createDataFrame([("p", None)], "video_id string, fea array<double>")
    with pytest.raises(Exception, match="without a feature vector"):
        max_similarity(pool, pool).collect()


def test_duplicate_anchors(spark):
    pool = spark.createDataFrame([(0, f"p{i}", [1.0, float(i)]) for i in range(7)], "fold int, video_id string, fea array<double>")
    anchors = spark.createDataFrame([(0, [1.0, 2.0])] * 12 + [(0, [0.0, 1.0])], "fold int, fea array<double>")
    got = {r.video_id: r.similarity for r in max_similarity(pool, anchors, by=["fold"], block_bytes=1).collect()}
    ref = _ref([(0, f"p{i}", [1.0, float(i)]) for i in range(7)], [(0, [1.0, 2.0]), (0, [0.0, 1.0])])
    assert all(math.isclose(got[k[1]], v, abs_tol=1e-12) for k, v in ref.items())


def _clusters(spark, n=3000, d=16, seed=4):
    """Rows around a few directions, as item vectors are."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + 0.05 * rng.normal(size=(n, d))
    return x


def test_blocks_that_cannot_win_are_skipped(spark):
    """Exact all the same, with few of the block pairs compared."""
    x, a = _clusters(spark), _clusters(spark, 600, seed=4)
    pool = spark.createDataFrame([(f"p{i}", [float(u) for u in v]) for i, v in enumerate(x)], "video_id string, fea array<double>")
    anchors = spark.createDataFrame([(0, [float(u) for u in v]) for v in a], "fold int, fea array<double>")
    met, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {r.video_id: r.similarity for r in max_similarity(pool.withColumn("fold", F.lit(0)), anchors, by=["fold"], block_bytes=16 * 16 * 8,
                                                            met=met, skipped=skipped).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (unit(x) @ unit(a).T).max(axis=1)
    assert max(abs(got[f"p{i}"] - w) for i, w in enumerate(want)) < 1e-12
    pairs = -(-len(x) // 16) * -(-len(a) // 16)
    assert 0 < met.value < pairs / 3


def test_spread_follows_the_cores_not_the_shuffle_partitions(spark):
    from poolwise.operators.similarity import draw_pivots, pack_pool
    x = _clusters(spark, 400)
    pool = spark.createDataFrame([(f"p{i}", [float(u) for u in v]) for i, v in enumerate(x)], "video_id string, fea array<double>")
    pivots = draw_pivots(pool)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            packed = pack_pool(pool, pivots)
            seen.append(packed.blocks.select("salt").distinct().count())
            assert packed.spread == spark.sparkContext.defaultParallelism
            packed.release()
        assert seen[0] == seen[1] <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_the_maximum_takes_bounded_scratch():
    """Never a whole block by block matrix; the same maxima and anchors."""
    import tracemalloc

    from poolwise.operators import similarity as sim
    rng = np.random.default_rng(8)
    x, a = rng.normal(size=(2000, 4)), rng.normal(size=(2100, 4))
    odd = np.array([[0.0] * 4, [np.nan, 1, 0, 0], [1e-9] * 4, [np.inf, 0, 0, 0]])
    for rows, anchors in ((x, a), (np.concatenate([x[:50], odd]), a), (x[:50], np.concatenate([odd, a])), (x[:3], odd[1:2]), (x[:3], a[:0])):
        norms = sim._norms(rows)
        tracemalloc.start()
        top, at = sim._max_cosine(rows, norms, anchors)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16e6  # the matrix alone would be 33 MB
        with np.errstate(invalid="ignore"):
            every = (rows @ anchors.T) / np.maximum(np.outer(norms, sim._norms(anchors)), sim.COSINE_EPS)
        every[np.isnan(every)] = -np.inf
        want = every.max(axis=1, initial=-np.inf)
        assert np.allclose(top, want, atol=1e-12)
        if len(anchors):
            assert np.allclose(every[np.arange(len(rows)), at], want, atol=1e-12)


def test_every_part_of_the_pool_is_a_task(spark):
    """Parts hashed into tasks would leave some tasks without work and give others several parts."""
    rng = np.random.default_rng(5)
    pool = spark.createDataFrame([(f"p{i}", rng.normal(size=6).tolist()) for i in range(400)], "video_id string, fea array<double>")
    anchors = spark.createDataFrame([(str(i % 2), f"a{i}", rng.normal(size=6).tolist()) for i in range(60)],
                                    "grp string, id string, vec array<double>")
    packed = similarity.pack_pool(pool, similarity.draw_pivots(pool), spread=6, block_bytes=6 * 8 * 16)
    needs = packed.blocks.select("salt", "block", F.array(F.lit("0|0")).alias("needs"))
    sent = packed.blocks.select("salt").distinct().select(
        "salt", F.lit("0|0").alias("ring"), F.lit("0").alias("grp"), F.lit(0).alias("pivot"), F.lit(0.0).alias("low"),
        F.lit(3.2).alias("high"), F.array(F.lit("a")).alias("names"), F.lit(1).alias("m"), F.lit(b"").alias("anchors"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = similarity._pairs(packed, needs, sent).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 6 and sum(r.n for r in got) == packed.blocks.count()
    found = {(r.id, r.grp): (r.sim, r.name) for r in similarity.best_anchors(packed, anchors, ["0", "1", "2"], 6 * 8 * 16).collect()}
    vectors = [(r.grp, r.id, np.array(r.vec)) for r in anchors.collect()]
    for r in pool.collect():
        v = np.array(r.fea)
        for g in "01":
            best = max((v @ a / np.linalg.norm(v) / np.linalg.norm(a), i) for h, i, a in vectors if h == g)
            assert found[r.video_id, g][1] == best[1] and abs(found[r.video_id, g][0] - best[0]) < 1e-12
        assert found[r.video_id, "2"] == (-1.0, None)


def test_vectors_are_placed_as_rows_are():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4))
    x[3], x[7, 1], x[9] = 0, np.nan, 1e-9
    pivots = x[20:24] / np.linalg.norm(x[20:24], axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec"]).slice(2, 40)
    for p in (pivots, np.zeros((0, 1))):
        out, = similarity._placed(p)([batch])
        angles = similarity._angles(x[2:42], p) if len(p) else np.full((40, 1), np.nan)
        near = similarity._nearest(angles)
        assert out.column("pivot").to_pylist() == near.tolist()
        assert out.column("angle").to_pylist() == [0.0 if k == similarity.LOOSE else a[k] for k, a in zip(near, angles)]
    for bad in ([[1.0], None], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            list(similarity._placed(pivots)([pa.RecordBatch.from_arrays([pa.array(bad, pa.list_(pa.float64()))], names=["vec"])]))
