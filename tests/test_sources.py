import os

import pytest
from pyspark.sql import functions as F

from poolwise.sources import io
from poolwise.sources import append_ids, parse_manifest, read_id_list, read_manifest


def test_manifest_with_malformed_line(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m.jsonl")
    with open(p, "w") as f:
        f.write('{"video_id": "a_TNVO_TMVO", "visual_materials": ["x_S0_E3"], "label": "fake", "source": "Generated_TNVO_TMVO"}\n')
        f.write('{"video_id": 123, "label": null}\n')
        f.write('not json\n')
    rows = read_manifest(spark, p, on_bad="quarantine").collect()
    assert len(rows) == 2
    assert rows[0].video_id == "a_TNVO_TMVO" and rows[0].visual_materials == ["x_S0_E3"]
    assert rows[1].video_id == "123"  # ids are strings
    bad = [r._bad for r in parse_manifest(spark, p).collect()]
    assert bad == [None, None, "not json"]
    with pytest.raises(ValueError, match="not json"):
        read_manifest(spark, p)


def test_manifest_line_without_id(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m.jsonl")
    with open(p, "w") as f:
        f.write('{"title": "x"}\n\n{"video_id": "b_TOVO_TOVM", "source": null}\n')
    assert [r.video_id for r in read_manifest(spark, p, on_bad="quarantine").collect()] == ["b_TOVO_TOVM"]


def test_checkpoint_folder_is_never_chosen_silently(spark):
    from poolwise.session import ensure_checkpoint_dir

    class Far:
        master = "spark://somewhere:7077"
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Far()
        class conf:
            @staticmethod
            def get(key, default):
                return default
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_id_list_strip(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "ids.txt")
    with open(p, "w", newline="") as f:
        f.write(" a\t\n\tb  \r\nc\n\n d\n")
    got = [r.video_id for r in read_id_list(spark, p).collect()]
    with open(p, newline=None) as f:
        ref = [line.strip() for line in f]
    assert got == ref


def test_append_ids_idempotent(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "sel")
    df = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (1, 0, "c")], "fold int, iteration int, video_id string")
    append_ids(df, p)
    append_ids(df, p)
    append_ids(df.filter("fold = 1").withColumn("iteration", F.lit(1)), p)
    assert io.read_version(spark, p).count() == 4


def test_a_write_that_dies_keeps_the_last_version(spark, tmpdir_path):
    import os

    import pytest

    path = tmpdir_path + "/ids"
    with pytest.raises(FileNotFoundError):
        io.read_version(spark, path)
    io.overwrite_ids(spark.range(10).selectExpr("cast(id as string) as video_id"), path)
    dies = spark.range(100, 200, numPartitions=4).selectExpr("if(id = 199, raise_error('lost'), cast(id as string)) as video_id")
    with pytest.raises(Exception, match="lost"):
        io.overwrite_ids(dies, path)
    assert sorted(int(r.video_id) for r in io.read_version(spark, path).collect()) == list(range(10))
    io.overwrite_ids(spark.range(3).selectExpr("cast(id as string) as video_id"), path)
    assert io.version_record(spark, path)["version"] == 1
    assert io.read_version(spark, path).count() == 3 and io.read_version(spark, path, 0).count() == 10
    assert io.vacuum(spark, path, keep=1) == 2  # the first write and the one that died
    assert io.read_version(spark, path).count() == 3
    io.overwrite_ids(spark.range(0).selectExpr("cast(id as string) as video_id"), path)
    assert io.read_version(spark, path).count() == 0
    # a draft record that was never put in place is no version
    with open(f"{path}/_commits/.data-x", "w") as f:
        f.write("{")
    assert io.version_record(spark, path)["version"] == 2
    # a number taken in the meantime is an error, and the table stays as the other writer left it
    os.rename(f"{path}/_commits/000000000002.json", f"{path}/_commits/000000000003.json")
    real = io._commits
    io._commits = lambda spark, p: [n for n in real(spark, p) if n < 3]
    try:
        with pytest.raises(RuntimeError, match="someone else"):
            io.overwrite_ids(spark.range(7).selectExpr("cast(id as string) as video_id"), path)
            io.overwrite_ids(spark.range(7).selectExpr("cast(id as string) as video_id"), path)
    finally:
        io._commits = real


def test_versions_replace_only_their_partitions(spark, tmpdir_path):
    path = tmpdir_path + "/ids"
    rows = [(f, 0, f"v{f}{i}") for f in range(3) for i in range(2)]
    df = spark.createDataFrame(rows, "fold int, iteration int, video_id string")
    append_ids(df, path)
    first = io.version_record(spark, path)["parts"]
    append_ids(df.filter("fold = 1 AND video_id = 'v10'"), path)
    second = io.version_record(spark, path)["parts"]
    assert {k for k in first if first[k] != second[k]} == {"_by_fold=1/_by_iteration=0"}
    assert sorted(map(tuple, io.read_version(spark, path).collect())) == sorted(r for r in rows if r[2] != "v11")
