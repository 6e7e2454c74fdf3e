"""Bucketed feature stores: no vector moves, the same rows, opened elsewhere."""
import uuid

import pytest
from pyspark.sql import functions as F

from poolwise.operators import sequences as sq
from poolwise.sources import store as st


def _seq(spark, n=40):
    return spark.range(n).selectExpr("cast(id as string) as key").withColumn("n", F.col("key").cast("int") % 9 + 1).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), F.array(F.lit(1.0), F.rand(3)).alias("vec"))


@pytest.fixture
def made(spark, tmpdir_path):
    from poolwise.session import cut_lineage
    seq = cut_lineage(_seq(spark))
    name = "t" + uuid.uuid4().hex[:8]
    s = st.write_store(seq, name, f"{tmpdir_path}/{name}", buckets=6)
    yield seq, s, f"{tmpdir_path}/{name}"
    st.drop_store(spark, s)


def _below_scan(plan, table):
    """Operators between the root and the scan of ``table``, top first."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if table in line and "FileScan" in line)
    out, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-*("))
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-*("))
        if d < depth:
            out.append(line.strip(" :+-*"))
            depth = d
    return out[::-1]


def test_no_exchange_above_the_vectors(spark, made):
    """Only wanted positions are shuffled; the store's rows are read in place,
    bucket by bucket."""
    _, s, _ = made
    keys = spark.range(40).selectExpr("cast(id as string) as key", "cast(id as string) as lookup")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (sq.fixed_length_fetch(keys, s.rows(spark), 5, ["vec"], lengths=s.lengths(spark)),
                    sq.whole_fetch(keys, s.rows(spark), s.lengths(spark), ["vec"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            above = _below_scan(plan, f"{s.rows_table}[")
            join = max(i for i, line in enumerate(above) if "Join" in line)
            assert not any("Exchange" in line for line in above[join:]), above
            assert "Bucketed: true" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_same_rows_as_a_plain_store(spark, made):
    seq, s, _ = made
    keys = spark.range(45).selectExpr("concat('i', id) as key", "cast(id % 41 as string) as lookup")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(sq.fixed_length_fetch(keys, seq, 5, ["vec"])) == rows(
        sq.fixed_length_fetch(keys, s.rows(spark), 5, ["vec"], lengths=s.lengths(spark)))
    plain = keys.join(seq.withColumnRenamed("key", "lookup"), "lookup").select("key", "pos", "vec")
    assert rows(plain) == rows(sq.whole_fetch(keys, s.rows(spark), s.lengths(spark), ["vec"]).select("key", "pos", "vec"))


def test_another_session_opens_it(spark, made):
    seq, s, path = made
    again = st.open_store(spark, s.rows_table + "_b", path, s.buckets)
    assert sorted(map(str, again.rows(spark).select(*seq.columns).collect())) == sorted(map(str, seq.collect()))
    assert again.lengths(spark).count() == 40
    st.drop_store(spark, again)


def test_bad_sequences_never_get_in(spark, tmpdir_path):
    bad = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0), ("b", 0, 1.0)], "key string, pos int, x double")
    name = "t" + uuid.uuid4().hex[:8]
    with pytest.raises(Exception, match="gaps or repeats"):
        st.write_store(bad, name, f"{tmpdir_path}/{name}", 2)
    s = st.write_store(bad, name, f"{tmpdir_path}/{name}-q", 2, on_bad="quarantine")
    assert [tuple(r) for r in s.rows(spark).collect()] == [("b", 0, 1.0)]
    st.drop_store(spark, s)
    with pytest.raises(ValueError, match="without a key"):
        st.write_store(spark.createDataFrame([(None, 0, 1.0)], "key string, pos int, x double"), name, f"{tmpdir_path}/{name}-n", 2)
    with pytest.raises(ValueError, match="table name"):
        st.write_store(bad, "a b", tmpdir_path, 2)
