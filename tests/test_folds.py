from pyspark.sql import functions as F

from poolwise.operators.folds import drop_half, fold_roles, kfold, random_sample, seeded_order


def test_kfold_partition_sizes(spark):
    ids = spark.createDataFrame([(f"v{i}",) for i in range(103)], "video_id string")
    f = kfold(ids, 5, 2025)
    rows = f.collect()
    assert len(rows) == 103 and len({r.video_id for r in rows}) == 103
    sizes = sorted(f.groupBy("fold").count().collect(), key=lambda r: r.fold)
    assert [r["count"] for r in sizes] == [21, 21, 21, 20, 20]  # first n % k folds one larger


def test_kfold_matches_ntile(spark):
    from pyspark.sql import Window
    ids = spark.createDataFrame([(f"x{i}",) for i in range(57)], "video_id string")
    f = kfold(ids, 5, 2025)
    w = Window.orderBy(F.md5(F.concat(F.lit("2025:"), "video_id")), "video_id")
    ref = ids.select("video_id", (F.ntile(5).over(w) - 1).alias("fold"))
    assert sorted(f.collect()) == sorted(ref.collect())


def test_fold_roles(spark):
    ids = spark.createDataFrame([(f"v{i}",) for i in range(10)], "video_id string")
    r = fold_roles(kfold(ids, 5), 5)
    assert r.count() == 50
    assert r.filter("role = 'val'").count() == 10


def test_drop_half_and_samples(spark):
    sel = spark.createDataFrame([(f, 0, f"v{i}") for f in range(3) for i in range(7 + f)],
                                "fold int, iteration int, video_id string")
    d = drop_half(sel, 2025)
    got = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}
    assert got == {0: 3, 1: 4, 2: 4}
    pool = spark.createDataFrame([(f"v{i}",) for i in range(40)], "video_id string")
    assert random_sample(pool, 9).count() == 9
    assert random_sample(pool, 100).count() == 40  # pool smaller than k
    o = seeded_order(pool)
    assert sorted(r.ord for r in o.collect()) == list(range(1, 41))
