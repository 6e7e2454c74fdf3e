"""The learned quality gate: held-out accuracy, whole results, edge cases."""
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from poolwise.operators import gate as g


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_held_out_rows_are_told_apart(spark, tables):
    docs, labels = tables
    fitted = g.fit_gate(docs, labels)
    rows = g.score(docs.select("doc_id", "text"), fitted.model).join(g.quality_label(labels), "doc_id").filter(g.held("doc_id")).collect()
    right = sum((r.score >= fitted.threshold) == (r.good == 1) for r in rows) / len(rows)
    common = max(sum(r.good for r in rows), sum(1 - r.good for r in rows)) / len(rows)
    assert len(rows) == fitted.n_held and right > common + 0.1 * (1 - common), (right, common)


def test_every_row_is_decided_and_labels_hold(spark, tables):
    docs, labels = tables
    out = g.learned_gate(docs, labels)
    assert out.count() == docs.count()
    good = {r.doc_id: r.good for r in g.quality_label(labels).collect()}
    for r in out.collect():
        assert (r.decided_by == "label") == (r.doc_id in good)
        if r.doc_id in good:
            assert r.kept == (good[r.doc_id] == 1)
    assert out.filter("decided_by = 'model'").select(F.count_distinct("kept")).first()[0] >= 1


def test_edges(spark, tables):
    docs, labels = tables
    fitted = g.fit_gate(docs, labels)
    odd = spark.createDataFrame([(None, None), (-5, ""), (-6, "word " * 50_000), (-7, "x"), (-7, "x")], "doc_id long, text string")
    out = g.learned_gate(odd, labels, gate=fitted).collect()
    assert len(out) == 5 and all(r.decided_by == "model" and r.kept is not None for r in out)
    assert g.learned_gate(odd.limit(0), labels, gate=fitted).count() == 0
    with pytest.raises(ValueError, match="both qualities"):
        g.fit_gate(docs, labels.filter("quality = 1 AND toxic = 0"))


def test_best_cut(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 1), (0.8, 1), (0.85, 1), (1.0, 1)], "score double, good int")
    assert g.best_cut(rows) == (0.3, 1.0, 6)
