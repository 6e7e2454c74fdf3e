from pyspark.sql import functions as F

from poolwise.functions.ids import (audio_key, clip_fields, encode_label, fabrication_fields,
                                    motion_key, seed_id, strip_ws)


def test_fabrication_fields(spark):
    df = spark.createDataFrame([("abc_TNVO_TMVO",), ("abc",), ("x_TOVO_TOVM",), ("y_TQVO_TMVO",)], "video_id string")
    f = fabrication_fields("video_id")
    rows = {r["video_id"]: r for r in df.select("video_id", *[c.alias(n) for n, c in f.items()]).collect()}
    r = rows["abc_TNVO_TMVO"]
    assert (r.seed_id, r.in_text, r.in_visual, r.out_text, r.out_visual) == \
        ("abc", "null", "original", "manipulated", "original")
    assert r.fabrication_type == "Groundless Fabrication"
    assert rows["abc"].fabrication_code is None and rows["abc"].fabrication_type is None
    assert rows["x_TOVO_TOVM"].fabrication_type == "Selective Editing"
    assert rows["y_TQVO_TMVO"].in_text is None  # malformed code


def test_clip_fields_and_keys(spark):
    df = spark.createDataFrame([("v1_S0_E207",), ("v2_S10_E",), ("v3",), ("v4_Sx_E3",)], "clip string")
    f = clip_fields("clip")
    got = [tuple(r) for r in df.select(f["src"], f["s"], f["e"]).collect()]
    assert got == [("v1", 0, 207), ("v2", 10, None), ("v3", None, None), ("v4", None, 3)]


def test_audio_motion_seed(spark):
    df = spark.createDataFrame([("a_TOVO_TMVO", ["src1_S0_E4", "src2_S1_E2"]), ("b", ["plain"])],
                               "video_id string, m array<string>")
    got = df.select(seed_id("video_id"), audio_key("m"), motion_key("video_id")).collect()
    assert tuple(got[0]) == ("a", "src1", "a")
    assert tuple(got[1]) == ("b", "plain", "b")


def test_encode_label_null_is_fake(spark):
    df = spark.createDataFrame([("real",), ("fake",), (None,), ("真",)], "label string")
    assert [r[0] for r in df.select(encode_label("label")).collect()] == [0, 1, 1, 1]
    assert [r[0] for r in df.select(encode_label("label", "真")).collect()] == [1, 1, 1, 0]


def test_strip_ws_like_python(spark):
    vals = ["  a\t", "\tb\r", "c", "   ", "d e ", "\u3000x\u00a0", "\x1cy\x1f", "\u2003z\u2029\x85", "\u200bk", "a\u3000b"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(strip_ws("v")).collect()] == [v.strip() for v in vals]
    # trim() would keep the tab
    assert df.select(F.trim("v")).collect()[0][0] == "a\t"
