"""Declared modalities: validation, the plan they give, unsound sequences."""
import pytest
from pyspark.sql import functions as F

from poolwise.operators.features import MODALITIES, Modality, default_modalities, feature_assemble, sequence_mean_pool
from poolwise.plans import active_learning as al


def _stores(spark):
    rows = [(k, p, float(10 * i + p)) for i, (k, n) in enumerate((("a", 5), ("b", 2), ("c", 9))) for p in range(n)]
    seq = spark.createDataFrame(rows, "key string, pos int, x double")
    bad = seq.unionByName(spark.createDataFrame([("d", 3, 1.0)], seq.schema))
    return {"s": seq, "bad": bad}


def _items(spark, keys):
    return spark.createDataFrame([(f"v{k}", k, [f"{k}_S1_E2"]) for k in keys], "video_id string, own string, clips array<string>")


def test_default_is_the_published_set():
    assert MODALITIES == ("text", "audio", "frames", "motion")
    assert [(m.how, m.length) for m in default_modalities()] == [("whole", None), ("stride", 50), ("clips", 83), ("stride", 83)]


@pytest.mark.parametrize("wrong", [dict(how="middle", length=3), dict(how="whole", length=3), dict(how="stride"), dict(how="head", length=0),
                                   dict(how="clips", length=3, key=lambda: F.lit("a"))])
def test_declarations_are_checked(wrong):
    with pytest.raises(ValueError):
        Modality("m", "s", wrong.pop("key", "own"), **wrong)


def test_every_sampling(spark):
    specs = [Modality("all", "s", "own", "whole"), Modality("some", "s", "own", "stride", 3), Modality("first", "s", lambda: F.col("own"), "head", 3),
             Modality("cut", "s", "clips", "clips", 3)]
    out = feature_assemble(_items(spark, "abc"), _stores(spark), modalities=specs)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.pos):
        got.setdefault((r.modality, r.video_id), []).append((r.x, r.mask))
    assert [x for x, _ in got["all", "vc"]] == [20.0 + p for p in range(9)]
    assert got["some", "vc"] == [(20.0, 1), (23.0, 1), (26.0, 1)] and got["some", "vb"] == [(10.0, 1), (11.0, 1), (0.0, 0)]
    assert got["first", "vc"] == [(20.0, 1), (21.0, 1), (22.0, 1)] and got["first", "vb"] == [(10.0, 1), (11.0, 1), (0.0, 0)]
    assert got["cut", "va"] == [(1.0, 1), (2.0, 1), (0.0, 0)] and got["cut", "vb"] == [(11.0, 1), (0.0, 0), (0.0, 0)]


def test_missing_and_unsound_sequences(spark):
    items, stores = _items(spark, "abd"), _stores(spark)
    one = [Modality("m", "bad", "own", "stride", 2)]
    with pytest.raises(Exception, match="gaps or repeats"):
        feature_assemble(items, stores, modalities=one).collect()
    kept = feature_assemble(items, stores, modalities=one, on_missing="quarantine")
    assert {r.video_id for r in kept.collect()} == {"va", "vb"}
    with pytest.raises(KeyError, match="missing m"):
        feature_assemble(items, stores, modalities=[Modality("m", "s", "own", "head", 2)])
    with pytest.raises(ValueError, match="no store"):
        feature_assemble(items, stores, modalities=[Modality("m", "other", "own", "head", 2)])
    with pytest.raises(ValueError, match="names of their own"):
        feature_assemble(items, stores, modalities=one * 2)


def test_sequences_are_proved_once_before_the_assembly(spark):
    """Neither mode proves positions again in the plan of the result; gaps,
    repeats and rows without a key take out the items that read them."""
    rows = [("a", p, float(p)) for p in range(9)] + [("b", 0, 1.0), ("b", 2, 2.0)] + [("c", 0, 1.0), ("c", 0, 1.0)] + [(None, 0, 5.0), ("d", 0, 7.0)]
    seq = spark.createDataFrame(rows, "key string, pos int, x double")
    specs = (Modality("few", "s", "k", "stride", 3), Modality("first", "s", "k", "head", 2), Modality("all", "s", "k", "whole"))
    items = spark.createDataFrame([(f"i-{k}", k) for k in "abcde"], "video_id string, k string")
    out = feature_assemble(items, {"s": seq}, ["x"], modalities=specs, on_missing="quarantine")
    got = sorted((r.video_id, r.modality, r.pos, r.x, r.mask) for r in out.collect())
    want = [("i-a", "few", k, 3.0 * k, 1) for k in range(3)] + [("i-a", "first", k, float(k), 1) for k in range(2)] + \
        [("i-a", "all", k, float(k), 1) for k in range(9)] + \
        [("i-d", "few", 0, 7.0, 1), ("i-d", "few", 1, 0.0, 0), ("i-d", "few", 2, 0.0, 0), ("i-d", "first", 0, 7.0, 1), ("i-d", "first", 1, 0.0, 0),
         ("i-d", "all", 0, 7.0, 1)]
    assert got == sorted(want)
    sound = feature_assemble(items.filter("k in ('a', 'd')"), {"s": seq.filter("key in ('a', 'd')")}, ["x"], modalities=specs)
    assert sorted((r.video_id, r.modality, r.pos, r.x, r.mask) for r in sound.collect()) == sorted(want)
    for df in (out, sound):
        assert "distinct" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pooling_by_sums_equals_the_summarizer(spark):
    rows = [(f"k{i % 300}", [float(i), i / 3, -1.5 * i]) for i in range(1200)]
    seq = spark.createDataFrame(rows, "key string, vec array<float>")
    found = lambda width: {(r.key, r.d): r["mean"] for r in sequence_mean_pool(seq, width=width).collect()}
    plain, sums = found(None), found(3)
    assert len(plain) == 900 and plain.keys() == sums.keys() and all(abs(plain[k] - sums[k]) < 1e-9 for k in plain)
    assert sequence_mean_pool(seq.limit(0), width=3).count() == 0
    for bad in ([1.0], [1.0, None, 2.0], None):
        with pytest.raises(Exception, match="3 entries"):
            sequence_mean_pool(seq.unionByName(spark.createDataFrame([("k0", bad)], seq.schema)), width=3).collect()


def test_items_are_computed_once_for_a_selection_run(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(str(i), ["real", "fake"][i % 2], "Human" if i < 40 else "Generated_x", [float(i % 5), 1.0, float(i % 3)]) for i in range(60)]
    items = spark.createDataFrame(rows, "video_id string, label string, source string, fea array<double>").mapInPandas(
        counted, "video_id string, label string, source string, fea array<double>")
    ids = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) video_id")
    data = al.prepare(items, ids(0, 30), ids(30, 40), None, al.ALConfig())
    assert seen.value == 60 and data.train.count() == 30 and data.test.count() == 10
