"""The classifier: gradients' effect as held-out accuracy, whole-text scoring
against a plain loop, and the defined cases."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.llm import toxicity as tx
from poolwise.llm.common import sample_of_texts


def made_up(n, seed):
    """Clean words from syllables; toxic texts have a telling stem somewhere."""
    rnd = random.Random(seed)
    syllables = "an be ci do er fu ga hi jo ka le mo na ow pi".split()
    rows = []
    for i in range(n):
        w = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["Zorgh!", "quuxi" + rnd.choice(syllables), "zorgh"]))
        rows.append((i, " ".join(w), "xx" if i % 2 else "yy", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = made_up(900, 1)
    return tx.train([r[1] for r in rows], [r[3] for r in rows], epochs=4)


def test_held_out_accuracy(net):
    rows = made_up(400, 2)
    scorer = tx.Scorer(net)
    s = net.score(np.array([scorer.pooled(r[1]) for r in rows]))
    y = np.array([r[3] for r in rows])
    assert ((s >= 0.7) == (y == 1)).mean() > 0.95


def test_pooling_matches_a_plain_loop(net, monkeypatch):
    monkeypatch.setattr(tx, "PIECE", 16)
    rows = made_up(30, 3) + [(0, "", "", 0), (0, None, "", 0), (0, "one", "", 0), (0, "Straße ÉÀ 漢字 " * 20, "", 0)]
    scorer = tx.Scorer(net, keep=50)
    for _, text, _, _ in rows:
        x = [net.embed(*tx.gram_buckets([w]))[0] for w in tx.words(text)] or [np.zeros(tx.DIM)]
        x += [np.zeros(tx.DIM)] * 2
        best = [max(sum(x[t + j] @ f[j][:, c] for j in range(w)) for t in range(len(x) - 2))
                for w, f in zip(tx.WIDTHS, net.filters) for c in range(tx.FILTERS)]
        assert np.allclose(scorer.pooled(text), best, atol=1e-4)


def test_words():
    assert tx.words("Ab-c  ÉÀ1!x\t\n") == [b"ab", b"c", "ÉÀ1".encode(), b"x"]
    assert tx.words(None) == []


def test_buckets_of_many_words_are_those_of_each():
    tokens = [b"a", "ÉÀ漢".encode(), b"long" * 30, b"ab", b"a"]
    flat, counts = tx.gram_buckets(tokens)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert all((p == tx.gram_buckets([w])[0]).all() for p, w in zip(parts, tokens)) and flat.max() < tx.BUCKETS


def test_calibration():
    net = tx.Convnet.fresh(np.random.default_rng(0))
    y = np.array([0] * 30 + [1] * 30)
    s = np.concatenate([np.linspace(0.1, 0.6, 30), np.linspace(0.75, 1, 30)])
    tx.calibrate(net, np.concatenate([s, s[:5]]), np.concatenate([y, y[:5]]), ["a"] * 60 + [None] * 5)
    assert set(net.thresholds) == {"a"} and 0.6 < net.thresholds["a"] <= 0.75


def table(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], r[2], "s", 1.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, _score double")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_query_and_filter(spark):
    rows = made_up(600, 4) + [(900, None, "xx", 0), (900, None, "xx", 0), (901, "", None, 0)]
    docs, labels = table(spark, rows)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None), (5, None, 7)], labels.schema))
    out = tx.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = {r.doc_id: r for r in out if r.held_out}
    right = [held[r[0]].predicted == r[3] for r in rows if r[0] in held]
    assert np.mean(right) > 0.9
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1
    kept = tx.without_toxic(docs.drop("_score"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    gone = {r[0] for r in rows} - {r.doc_id for r in kept.collect()}
    assert gone == {r.doc_id for r in out if r.rejected}


def test_no_labels_and_empty(spark):
    docs, labels = table(spark, made_up(5, 5))
    assert {r.score for r in tx.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert tx.toxicity(docs.limit(0), labels).collect() == []
    one = {round(r.score, 6) for r in tx.toxicity(docs, labels.filter("toxic = 0")).collect()}
    assert one == {0.01}


def test_a_very_long_text_does_not_end_the_sample(spark):
    rows = made_up(60, 6)
    order = F.md5(F.col("doc_id").cast("string"))
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, toxic int")
    first = df.orderBy(order).first().doc_id
    long = df.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("éx "), 100_000)).otherwise(F.col("text")))
    plain = {r[0]: r[1] for r in rows}
    got = sample_of_texts(long, order, 200_000, by="toxic")
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in plain.items() if i != first}  # whole texts only, and all that fit
    assert sum(len((r.text or "").encode()) for r in got) <= 200_000
    got = sample_of_texts(long, order, 2_000_000, by="toxic")
    assert {r.doc_id: r.text for r in got} == {**plain, first: "éx " * 100_000}
    alone = sample_of_texts(long.filter(F.col("doc_id") == first), order, 1000)
    assert [r.text for r in alone] == ["éx " * 100_000]  # a group is never left without a row


def test_training_with_a_very_long_first_text(spark):
    rows = made_up(300, 7)
    ids = sorted((r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, "word " * 60_000 if i == ids[0] else t, lang, y) for i, t, lang, y in rows]
    docs, labels = table(spark, rows)
    net = tx.fit(docs.drop("_score"), labels, max_bytes=200_000)
    scorer, rest = tx.Scorer(net), made_up(100, 8)
    s = net.score(np.array([scorer.pooled(r[1]) for r in rest]))
    assert np.mean((s >= 0.5) == np.array([r[3] == 1 for r in rest])) > 0.8


def test_all_labelled_rows_train_and_calibrate(spark):
    """A start of few rows does not know the stems that only other rows have;
    odds and thresholds are counted over all rows."""
    rows = [(i, t, lang, y) for i, t, lang, y in made_up(900, 11)]
    docs, labels = table(spark, rows)
    every = tx.labelled(docs.drop("_score"), labels)
    mine = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert {r.doc_id for r in every.collect()} == mine
    odds, texts = tx.bucket_odds(every.repartition(3))
    kept = [r for r in rows if r[0] in mine]
    y = np.array([r[3] for r in kept])
    d = tx._bucketed([r[1] for r in kept])
    assert texts.tolist() == np.bincount(y).tolist()
    assert np.allclose(odds, tx._odds(tx._seen(*d, y), np.bincount(y)))
    net = tx.fit(docs.drop("_score"), labels, max_rows=10)
    assert set(net.thresholds) == {"yy"}  # xx has no toxic row; a fifth of ten rows could set none
    rest, scorer = made_up(200, 12), tx.Scorer(net)
    s = net.score(np.array([scorer.pooled(r[1]) for r in rest]))
    assert np.mean((s >= 0.5) == np.array([r[3] == 1 for r in rest])) > 0.9
    moved = tx.refine(net, every.filter("toxic = 1").limit(5), texts)
    assert (moved.grams != net.grams).any() and (moved.out != net.out).any()


def test_a_long_text_is_trained_on_in_pieces(net, monkeypatch):
    docs, flat, starts = tx._bucketed([made_up(40, 13)[k][1] for k in range(40)])
    buckets, sizes = tx._lists(flat, starts, np.arange(len(starts) - 1))
    projected = net.project(np.concatenate([net.embed(buckets, sizes), np.zeros((1, tx.DIM), np.float32)]))
    ids = np.concatenate([*docs, [len(sizes)] * 2])
    where, best = tx._peaks(net, projected, ids)
    monkeypatch.setattr(tx, "PIECE", 16)
    again, same = tx._peaks(net, projected, ids)
    assert np.array_equal(best, same) and all(np.array_equal(a, b) for a, b in zip(where, again))


def test_labels_meet_texts_by_one_plan_at_any_size(spark):
    """A broadcast of labels ends at some size; from there on texts would be
    shuffled that were not before."""
    rows = made_up(60, 14)
    docs, labels = table(spark, rows)
    docs = docs.drop("_score").unionByName(docs.drop("_score").filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    joined = tx.with_label(docs, labels.unionByName(labels))
    got = sorted((r.doc_id, r.text, r.lang, r.toxic) for r in joined.collect())
    assert got == sorted(r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
