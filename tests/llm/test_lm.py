"""The language model: normalised, causal, scored once per id; better than the
unigram base on held-out texts; the base against exact counts."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from poolwise.llm import lm


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    tree = lm.build_tree(rng.random(lm.IDS) ** 4 + 1e-3, rng.normal(size=(lm.IDS, 3)))
    m = lm.Model.fresh(tree)
    m.p["node"] += rng.normal(0, 0.3, m.p["node"].shape).astype(np.float32)
    m.p["near"] += rng.normal(0, 0.3, m.p["near"].shape).astype(np.float32)
    return m


def test_probabilities_sum_to_one(model):
    states, _ = model.states(np.array([[lm.END, 5, 7, 7]]))
    every = model.log_probs(np.repeat(states[0, -1:], lm.IDS, axis=0), np.arange(lm.IDS))
    assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-3)


def slow_score(m, ids):
    """One id at a time: the window that scores it, read up to it."""
    total, p = 0.0, m.p
    seq = [lm.END, *ids]
    for t in range(len(ids)):
        w = 0 if t < lm.LENGTH else -(-(t + 1 - lm.LENGTH) // lm.STRIDE)
        context = seq[w * lm.STRIDE: t + 1]
        x = p["embed"][context].astype(float)
        y = x + p["place"][: len(context)]
        i = len(context) - 1
        s = (y[i] @ p["q"]) @ (y @ p["k"]).T / math.sqrt(lm.DIM) + p["near"][i, : i + 1]
        a = np.exp(s) / np.exp(s).sum() @ (x @ p["v"])
        state = np.maximum(np.concatenate([x[i], a]) @ p["w1"] + p["b1"], 0) @ p["w2"] + x[i] @ p["skip"]
        lo, hi = m.tree.start[ids[t]], m.tree.start[ids[t] + 1]
        z = p["node"][m.tree.node[lo:hi]] @ state + p["bias"][m.tree.node[lo:hi]]
        total -= np.logaddexp(0, -m.tree.sign[lo:hi] * z).sum()
    return total / math.log(10)


def test_windows_score_every_id_once(model):
    rnd = random.Random(2)
    docs = [np.array([rnd.randrange(lm.IDS) for _ in range(n)], dtype=np.int32)
            for n in (1, 2, 23, 24, 31, 32, 33, 55, 56, 57, 80, 81, 200)]
    for d in docs:
        assert lm.windows(d)[2].sum() == len(d)
    assert np.allclose(lm.score_ids(model, docs, batch=3), [slow_score(model, d) for d in docs], rtol=1e-4)


def test_training_gradients(model):
    """A few steps on one repeated text make it likelier."""
    m = lm.Model.fresh(model.tree)
    doc = np.array(list(range(100, 150)) * 2, dtype=np.int32)
    before = lm.score_ids(m, [doc])[0]
    lm.train(m, [doc], steps=60, batch=4)
    assert lm.score_ids(m, [doc])[0] > before + 20


def test_tree_reaches_every_id():
    tree = lm.build_tree(np.ones(37), np.zeros((37, 2)))
    seen = {tuple(zip(tree.node[a:b], tree.sign[a:b])) for a, b in zip(tree.start, tree.start[1:])}
    assert len(seen) == 37 and len(tree.bias) == 36


def test_speller_round_trip():
    s = lm.Speller(lm.tokenizer_path(), keep=3)
    for text in ("Hello  there\tfriend", "ÉÀ 漢字 x'y  z", "", "a " * 50):
        w = lm.words(text)
        ids = s.ids(s.numbers(w))
        assert ids[-1] == lm.END
        assert s.encoding.decode(ids[:-1].tolist()) == "".join(" " + x.decode() for x in w)


def test_a_full_speller_forgets_the_later_half_only():
    s = lm.Speller(lm.tokenizer_path(), keep=6)
    early, late = s.numbers(b"the of and to".split()), s.numbers(b"zyx wvu tsr qpo".split())
    generation, first = s.generation, s.ids(early).tolist()
    assert s.ids(s.numbers([b"new"])).tolist() == s.ids(s.numbers([b"new"])).tolist()
    assert s.generation == generation + 1 and s.words == [b"the", b"of", b"and", b"to", b"new"]
    assert s.ids(s.numbers(b"the of and to".split())).tolist() == first and s.used == s.lengths[:len(s.words)].sum()
    assert s.encoding.decode(s.ids(s.numbers([b"zyx", b"new"]))[:-1].tolist()) == " zyx new" and len(late) == 4


def test_tasks_that_learn_or_score_get_small_batches(spark, monkeypatch):
    key, seen, before = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, {n: getattr(lm, n) for n in ("written", "fit")}
    monkeypatch.setattr(lm, "written", lambda df, name, *a: (seen.update({name: int(spark.conf.get(key))}), before["written"](df, name, *a))[1])
    monkeypatch.setattr(lm, "fit", lambda *a, **k: (seen.update({"fit": int(spark.conf.get(key))}), before["fit"](*a, **k))[1])
    old = spark.conf.get(key)
    assert lm.score(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), steps=2).count() == 2
    assert max(seen["fit"], seen["lm-rows"]) <= lm.ROWS and spark.conf.get(key) == old


def test_words_are_counted_in_pieces(spark):
    texts = [f"w{i % 7} w{i} Same" for i in range(2 * lm.ROWS + 5)] + [None, "", " w0 "]
    want = Counter(w.decode() for t in texts for w in lm.words(t)) + Counter({lm.END_WORD: len(texts)})
    got = lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    assert len(got) == len(want) and {r.word: r.c for r in got} == want


def base(rows):
    """Exact unigram scores."""
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    out = {zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = Counter()
    for (_, w), h in zip(split, held):
        if not h:
            count.update([*w, None])
    n, v = sum(count.values()), len(count)
    return [(str(i), h, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n,
             sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])) for (i, w), h in zip(split, held)]


def test_query(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice(["ra", "ne", "to", "li", "su"]) for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    rows = [(i, " ".join(f"{vocab[k]} {vocab[(k * 7 + 1) % 150]}" for k in (int(149 * rnd.random() ** 3) for _ in range(60))))
            for i in range(150)]
    rows += [(None, "Ne w One"), (None, None), (7, ""), (7, "twice"), (7, "twice"), (9, "hot " * 20_000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    got = lm.score(df, common=20, steps=200).collect()
    want = sorted(base(rows), key=str)
    mine = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in mine], [x[5] for x in want])
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, steps=2).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), steps=2).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0
    assert row.score < 0


def test_coded_words_are_the_words():
    import pyarrow as pa

    texts = ["", None, " a\tB  ÀÉ\n", "x" * 500, "\n\r\x0b\x0c ", "a b A", "  lead", "trail  ", "a a b  \x85 c"] * 3000
    whole = pa.array(texts, pa.string())
    for at, n in ((0, 50), (2, 9), (1024, 1024), (20_000, 7000)):  # slices, too
        starts, codes, names = lm.coded_words(whole.slice(at, n))
        assert [[names[k] for k in codes[a:b]] for a, b in zip(starts, starts[1:])] == [lm.words(t) for t in texts[at:at + n]]


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i * i) for i in range(200)], "word string, c long")
    for most in (0, 1, 50, 199, 200, 10 ** 6):
        got = lm.frequent_words(counts, most)
        assert len(got) <= most and (most < 200 or len(got) == 200)
        assert not got or set(got.values()) == {1 + i * i for i in range(200) if 1 + i * i >= min(got.values())}


def test_parameters_learn_from_texts_outside_the_sample(spark, model):
    """Words that no sampled text has still move their ids' rows."""
    rows = [(i, "zebra quartz violin " * 2000) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = lm.tokenizer_path()
    speller = lm.Speller(path)
    ids = speller.ids(speller.numbers(lm.words(rows[0][1])))
    m = lm.Model.fresh(model.tree)
    start, before = m.p["embed"].copy(), lm.score_ids(m, [ids])[0]
    lm.refine(m, df, path, one_in=2)
    moved = np.flatnonzero((m.p["embed"] != start).any(1))
    assert set(moved) == set(ids) and lm.score_ids(m, [ids])[0] > before + 1
    assert all(np.isfinite(v).all() for v in m.p.values())


def test_every_training_text_moves_the_model(spark, model):
    """Each text has a word of its own; all of them are learned, and the ids'
    places in the tree come from all texts."""
    path = lm.tokenizer_path()
    speller = lm.Speller(path)
    own = [w for w in ("zebra quartz violin hammer lantern pepper rocket saddle tunnel walnut yogurt magnet "
                       "forest bottle candle dragon").split()]
    df = spark.createDataFrame([(i, f"{w} " * 400) for i, w in enumerate(own)], "doc_id long, text string").repartition(4)
    m = lm.Model(model.tree, {k: v.copy() for k, v in model.p.items()})
    start = m.p["embed"].copy()
    lm.refine(m, df, path)
    used = {int(k) for w in own for k in speller.ids(speller.numbers([w.encode()]))}
    assert set(np.flatnonzero((m.p["embed"] != start).any(1))) == used
    usage = np.zeros(lm.IDS)
    for w in own:
        np.add.at(usage, speller.ids(speller.numbers([w.encode()] * 400)), 1)
    place = lm.neighbourhoods(df, usage, path)
    assert set(np.flatnonzero((np.abs(place) > 1e-6).any(1))) == used
    assert np.array_equal(place, lm.neighbourhoods(df.repartition(2), usage, path))


def test_neighbourhoods_match_plain_counts(spark):
    path = lm.tokenizer_path()
    speller = lm.Speller(path)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("red blue green old new tree house".split()) for _ in range(rnd.randint(0, 40))) for _ in range(30)]
    docs = [speller.ids(speller.numbers(lm.words(t))) for t in [*texts, None]]
    usage = np.bincount(np.concatenate(docs), minlength=lm.IDS).astype(float)
    top = np.argsort(-usage, kind="stable")[:5]
    table = np.zeros((lm.IDS, 5))
    for d in docs:
        seq = [lm.END, *d]
        for t in range(1, len(seq)):
            for gap in (1, 2, 3):
                if t >= gap and seq[t - gap] in top:
                    table[seq[t], list(top).index(seq[t - gap])] += 1 / gap
    share = np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 5))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3)
    place = lm.neighbourhoods(df, usage, path, context=5, dim=5)
    used = np.flatnonzero(usage)
    assert np.allclose(place[used] @ place[used].T, share[used] @ share[used].T, atol=1e-3)
