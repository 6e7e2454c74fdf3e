import pytest
from pyspark.sql import functions as F

from poolwise.operators import sequences as sq
from poolwise.operators.sequences import (bad_clips, clip_frames, clip_lengths, fixed_length, head_pad,
                                          shot_segments, stride_sample)


def _seq(spark, lens):
    rows = [(k, p, float(p) + 0.5) for k, n in lens.items() for p in range(n)]
    return spark.createDataFrame(rows, "key string, pos int, x double")


def _ref_stride(n, L):
    idx = list(range(n))
    if n >= L:
        gap = n // L
        idx = idx[::gap][:L]
    return idx


@pytest.mark.parametrize("L", [16, 50])
def test_stride_sample_branches(spark, L):
    lens = {"a": L, "b": L - 1, "c": 2 * L - 1, "d": 3 * L + 2, "e": 1}
    got = stride_sample(_seq(spark, lens), L).collect()
    for k, n in lens.items():
        rows = sorted((r.pos, r.x) for r in got if r.key == k)
        ref = _ref_stride(n, L)
        assert len(rows) == min(n, L)
        assert [x for _, x in rows] == [i + 0.5 for i in ref]
        assert [p for p, _ in rows] == list(range(len(ref)))


def test_fixed_length_pads_and_masks(spark):
    out = fixed_length(_seq(spark, {"a": 3, "b": 10}), 5, ["x"]).collect()
    a = sorted((r.pos, r.x, r.mask) for r in out if r.key == "a")
    assert a == [(0, 0.5, 1), (1, 1.5, 1), (2, 2.5, 1), (3, 0.0, 0), (4, 0.0, 0)]
    b = sorted((r.pos, r.x, r.mask) for r in out if r.key == "b")
    assert b == [(i, 2 * i + 0.5, 1) for i in range(5)]


def test_head_pad_with_empty_key(spark):
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    out = head_pad(_seq(spark, {"a": 7}), 4, ["x"], keys=keys).collect()
    assert sorted((r.key, r.pos, r.x) for r in out) == \
        [("a", 0, 0.5), ("a", 1, 1.5), ("a", 2, 2.5), ("a", 3, 3.5)] + [("z", i, 0.0) for i in range(4)]


def test_clip_frames_edge_cases(spark):
    frames = _seq(spark, {"s1": 10, "s2": 4})
    clips = spark.createDataFrame([
        (1, 1, "s1_S2_E4"),    # inside
        (1, 2, "s2_S3_E9"),    # reaches past the end
        (1, 3, "s1_S12_E15"),  # starts past the end: empty
        (1, 4, "s1_S5_E3"),    # s > e: empty
        (1, 5, "s2_S0_E0"),
        (2, 1, "bad"),         # malformed: quarantined
    ], "item_id long, material_pos int, clip string")

    def ref(src_n, s, e):  # the reference's slice of a source with src_n frames
        return list(range(src_n))[min(src_n, s):min(src_n, e) + 1]
    expect = [p + 0.5 for p in ref(10, 2, 4)] + [p + 0.5 for p in ref(4, 3, 9)] + [0.5]
    with pytest.raises(ValueError, match="bad"):
        clip_frames(clips, frames)
    got = sorted((r.pos, r.x) for r in clip_frames(clips, frames, on_bad="quarantine").collect())
    assert [x for _, x in got] == expect
    assert [p for p, _ in got] == list(range(len(expect)))
    lens = {r.material_pos: r.len for r in clip_lengths(clips, frames, on_bad="quarantine").collect() if r.item_id == 1}
    assert lens == {1: 3, 2: 1, 3: 0, 4: 0, 5: 1}


def test_a_bad_clip_takes_its_whole_item_out(spark):
    frames = _seq(spark, {"s1": 10})
    clips = spark.createDataFrame([(1, 1, "s1_S0_E1"), (1, 2, "s1_Sx_E3"), (1, 3, "s1_S4_E5"), (2, 1, "gone_S0_E1"),
                                   (2, 2, "s1_S0_E0"), (3, 1, "s1_S9_E9")], "item_id long, material_pos int, clip string")
    assert sorted((r.item_id, r.clip, r.reason) for r in bad_clips(clips, frames).collect()) == [
        (1, "s1_Sx_E3", "malformed"), (2, "gone_S0_E1", "no frames")]
    assert {r.item_id for r in clip_frames(clips, frames, on_bad="quarantine").collect()} == {3}


def test_clip_join_of_a_popular_source(spark):
    """Nine clips in ten cut the same long source: right rows, and no clip
    meets frames outside its buckets."""
    frames = _seq(spark, {"hot": 2000, "s": 300})
    clips = spark.createDataFrame([(i, 0, f"{'hot' if i % 10 else 's'}_S{i * 3 % 290}_E{i * 3 % 290 + 70}") for i in range(200)],
                                  "item_id long, material_pos int, clip string")
    got = sorted((r.item_id, r.pos, r.x) for r in clip_frames(clips, frames).collect())
    want = [(i, p, i * 3 % 290 + p + 0.5) for i in range(200) for p in range(min(71, (2000 if i % 10 else 300) - i * 3 % 290))]
    assert got == want


def test_shot_segments(spark):
    rows = [("v", 0, [1.0, 0.0]), ("v", 1, [0.9, 0.1]), ("v", 2, [0.0, 1.0]), ("v", 3, [0.1, 0.9]),
            ("w", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, pos int, vec array<double>")
    got = sorted((r.key, r.segment, r.start_pos, r.end_pos, r.clip) for r in shot_segments(df, 0.5).collect())
    assert got == [("v", 0, 0, 1, "v_S0_E1"), ("v", 1, 2, 3, "v_S2_E3"), ("w", 0, 0, 0, "w_S0_E0")]


@pytest.mark.parametrize("L", [4, 9])
def test_sample_before_fetch_parity(spark, L):
    from poolwise.operators.sequences import clip_frames, fixed_length_fetch, sampled_clip_frames
    frames = _seq(spark, {"s1": 23, "s2": 6, "s3": 2})
    clips = spark.createDataFrame([
        (1, 0, "s1_S2_E20"), (1, 1, "s2_S0_E9"), (2, 0, "s3_S0_E1"), (3, 0, "s1_S30_E40"),
        (4, 0, "s2_S1_E2"), (4, 1, "s1_S0_E22"), (4, 2, "s3_S1_E1"),
    ], "item_id long, material_pos int, clip string")
    direct = fixed_length(clip_frames(clips, frames).withColumnRenamed("item_id", "key"), L, ["x"])
    fast = sampled_clip_frames(clips, frames, L, ["x"])
    norm = lambda df: sorted((str(r.key), r.pos, r.x, r.mask) for r in df.collect())
    got, ref = norm(fast), norm(direct)
    # item 3 has only an empty clip: the reference pads it to L zero rows
    assert [t for t in got if t[0] == "3"] == [("3", p, 0.0, 0) for p in range(L)]
    assert [t for t in got if t[0] != "3"] == ref
    keys = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s1")], "key string, lookup string")
    seqs = keys.join(frames.withColumnRenamed("key", "lookup"), "lookup").drop("lookup")
    assert norm(fixed_length_fetch(keys, frames, L, ["x"])) == norm(fixed_length(seqs, L, ["x"]))


def test_feature_assemble_fail_and_quarantine(spark):
    from poolwise.operators.features import feature_assemble
    seq = _seq(spark, {"s1": 100, "s2": 30, "v1": 5, "v2": 7})
    items = spark.createDataFrame([("v1", ["s1_S0_E90"]), ("v2", ["s2_S5_E9", "s1_S3_E3"]), ("v3", ["s9_S0_E1"])],
                                  "video_id string, visual_materials array<string>")
    stores = {"text": seq, "audio": seq, "frames": seq, "motion": seq}
    with pytest.raises(KeyError):
        feature_assemble(items, stores)
    out = feature_assemble(items, stores, on_missing="quarantine").collect()
    assert {r.video_id for r in out} == {"v1", "v2"}
    per = {}
    for r in out:
        per[(r.video_id, r.modality)] = per.get((r.video_id, r.modality), 0) + 1
    assert per[("v1", "frames")] == 83 and per[("v1", "audio")] == 50 and per[("v2", "motion")] == 83
    assert per[("v1", "text")] == 5 and per[("v2", "text")] == 7
    v2f = sorted((r.pos, r.x, r.mask) for r in out if r.video_id == "v2" and r.modality == "frames")
    assert [x for _, x, m in v2f if m] == [5.5, 6.5, 7.5, 8.5, 9.5, 3.5]


def test_malformed_clips_are_reported(spark):
    from poolwise.operators.features import missing_features
    seq = _seq(spark, {"s1": 10})
    items = spark.createDataFrame([("a", ["s1_S0_E3"]), ("b", ["s1"]), ("c", []), ("d", ["s1_S1_E2", "s1_Sx_E2"])],
                                  "video_id string, visual_materials array<string>")
    seq_k = seq.withColumn("key", F.lit("a")).unionByName(seq.withColumn("key", F.lit("d")))
    stores = {"text": seq_k, "audio": seq, "frames": seq, "motion": seq_k}
    got = {(r.video_id, r.modality, r.missing_key) for r in missing_features(items, stores).collect()}
    assert ("b", "clip", "s1") in got and ("c", "clip", "") in got and ("d", "clip", "s1_Sx_E2") in got
    assert not any(v == "a" for v, _, _ in got)


def test_shot_segments_rank_form_equals_window_form(spark):
    import numpy as np
    from plain import shot_segments_window
    rng = np.random.default_rng(5)
    rows = [(f"k{k}", int(p), [float(v) for v in rng.normal(size=3)])
            for k in range(4) for p in rng.choice(200, size=40 + 10 * k, replace=False)]
    df = spark.createDataFrame(rows, "key string, pos int, vec array<double>")
    a = sorted(tuple(r) for r in shot_segments(df, 0.2).select("key", "segment", "start_pos", "end_pos",
                                                               "n_frames", "clip").collect())
    b = sorted(tuple(r) for r in shot_segments_window(df, 0.2).select("key", "segment", "start_pos", "end_pos",
                                                                      "n_frames", "clip").collect())
    assert a == b and len(a) > 8


def _gappy(spark):
    rows = [("ok", p, float(p)) for p in range(6)] + [("gap", p, 1.0) for p in (0, 1, 5, 6)] + [("twice", p, 1.0) for p in (0, 1, 1, 2)] \
        + [("late", p, 1.0) for p in (1, 2)] + [("no", None, 1.0)]
    return spark.createDataFrame(rows, "key string, pos int, x double")


def test_positions_are_proved_before_they_are_trusted(spark):
    """A gap or repeat never loses rows silently: it raises, or the key goes
    as a whole."""
    seq = _gappy(spark)
    proof = {r.key: (r.n, r.dense) for r in sq.sequence_proof(seq).collect()}
    assert proof == {"ok": (6, True), "gap": (4, False), "twice": (4, False), "late": (2, False), "no": (1, False)}
    calls = (lambda s, **kw: sq.stride_sample(s, 10, **kw), lambda s, **kw: sq.fixed_length(s, 6, ["x"], **kw),
             lambda s, **kw: sq.head_pad(s, 7, ["x"], **kw))
    for call in calls:
        with pytest.raises(Exception, match="gaps or repeats"):
            call(seq).collect()
        kept = call(seq, on_bad="quarantine")
        assert {r.key for r in kept.collect()} == {"ok"}
        assert sorted(map(str, kept.collect())) == sorted(map(str, call(seq.filter("key = 'ok'")).collect()))
    clips = spark.createDataFrame([(1, 0, "ok_S0_E2"), (2, 0, "gap_S0_E2"), (2, 1, "ok_S1_E2")], "item_id int, material_pos int, clip string")
    with pytest.raises(Exception, match="gaps or repeats"):
        sq.clip_lengths(clips, seq).collect()
    assert {r.item_id for r in sq.clip_lengths(clips, seq, on_bad="quarantine").collect()} == {1}


def test_sequence_faults(spark):
    nan = float("nan")
    rows = [("ok", 0, [1.0, 2.0]), ("ok", 1, [0.0, 0.0]), ("gap", 1, [1.0, 1.0]), ("twice", 0, [1.0, 1.0]), ("twice", 0, [1.0, 1.0]),
            ("none", 0, None), ("wide", 0, [1.0, 1.0]), ("wide", 1, [1.0]), ("nan", 0, [1.0, nan]), ("nan", 2, [float("inf"), 0.0]),
            ("hole", 0, [1.0, None]), ("nopos", None, [1.0, 1.0]), (None, 0, [1.0, 1.0])]
    seq = spark.createDataFrame(rows, "key string, pos int, vec array<double>")
    got = sorted((r.key or "", r.reason) for r in sq.sequence_faults(seq).collect())
    assert got == [("gap", "gap"), ("hole", "not a number"), ("nan", "gap"), ("nan", "not a number"), ("none", "no vector"),
                   ("nopos", "gap"), ("twice", "repeat"), ("wide", "width")]
    assert {r.key for r in sq.sound_sequences(seq).collect()} == {"ok"}
    assert ("ok", "width") in {(r.key, r.reason) for r in sq.sequence_faults(seq, width=3).collect()}
    assert sq.sequence_faults(seq.limit(0)).count() == 0
