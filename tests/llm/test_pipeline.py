"""The pipeline's stages, each on what the one before kept, against plain
versions."""
import math
from collections import Counter

import pytest

import corpus_pipeline as cp
from poolwise.llm import toxicity
from poolwise.llm.common import written
from test_decontam import slow as slow_decontam
from test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = {r.doc_id for r in toxicity.toxicity(stages[0], labels).collect() if r.rejected}
    assert rows(stages[1]) == Counter({k: n for k, n in rows(stages[0]).items() if k[0] not in gone})
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(gone & clean) <= 0.02 * len(clean)


def test_near_duplicates(stages):
    before = stages[1].collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in before}
    roots, least = slow_components(fps.values()), {}
    for i in sorted(fps, reverse=True):
        least[roots[fps[i]]] = i
    assert {r.doc_id for r in stages[2].collect()} == set(least.values())


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marked = slow_decontam([(r.doc_id, r.text) for r in stages[2].collect()], items)
    dirty = {x[0] for x in marked if x[-1]}
    assert {str(r.doc_id) for r in stages[3].collect()} == {x[0] for x in marked} - dirty


def test_mixing_keeps_every_document(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after) and all(after[k] >= n for k, n in before.items())


def test_sharding(stages):
    before = Counter((r.doc_id, len((r.text or "").encode()) + 8) for r in stages[4].collect())
    got = stages[5].collect()
    assert Counter((r.doc_id, r.size) for r in got) == before
    mean, top = sum(r.size for r in got) / 24, max(r.size for r in got)
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    assert all(abs(held[s] - mean) <= top for s in range(24))


def test_run(spark, stages):
    assert cp.ORACLE_SQL is None
    got = cp.run(spark, SF)
    assert Counter(map(str, got.collect())) == Counter(map(str, stages[5].collect()))
