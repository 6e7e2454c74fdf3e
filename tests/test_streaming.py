import os

from conftest import SF001
from poolwise.operators.pool import generated_pool
from poolwise.plans import fixtures as fx
from poolwise.streaming import pool_stream, write_pool_stream


def test_stream_intake_equals_batch_pool(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    man = fx.fx_manifest(spark, SF001)
    man.filter("CAST(split_part(video_id, '_', 1) AS INT) % 2 = 0").write.json(os.path.join(src, "a"))
    seeds = fx.fx_seed_ids(spark, SF001)
    out = os.path.join(tmpdir_path, "out")
    q = write_pool_stream(pool_stream(spark, os.path.join(src, "*"), seeds), out, os.path.join(tmpdir_path, "cp"))
    q.awaitTermination(120)
    # a second file arrives; only it is processed by the next run
    man.filter("CAST(split_part(video_id, '_', 1) AS INT) % 2 = 1").write.json(os.path.join(src, "b"))
    q = write_pool_stream(pool_stream(spark, os.path.join(src, "*"), seeds), out, os.path.join(tmpdir_path, "cp"))
    q.awaitTermination(120)
    got = sorted(r.video_id for r in spark.read.parquet(out).collect())
    ref = sorted(r.video_id for r in generated_pool(man, seeds).collect())
    assert got == ref and len(got) > 0
