"""Mixing: posteriors on held-out rows, rates against a dense solver."""
import random

import numpy as np
import pytest

from poolwise.llm import mixing as mx


def rows_of(n, seed):
    rnd = random.Random(seed)
    kinds = {"en": "the of and to in".split(), "de": "der die und ein zu".split(), "fr": "le la des et une".split()}
    out = []
    for i in range(n):
        lang = "en" if i % 2 else ("de" if i % 4 else "fr")
        bad = i % 5 == 0
        w = [rnd.choice(kinds[lang]) + rnd.choice(["", "ra", "xo"]) for _ in range(rnd.randint(20, 120))]
        out.append((i, " ### ".join(w) if bad else " ".join(w), lang, int(not bad)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], r[2], "x") for r in rows], "doc_id long, text string, lang string, domain string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_features_are_the_same_in_pieces():
    x, n = mx.featurise("Ab c " * 10)
    assert n == 20 and abs((x ** 2).sum() - 1) < 1e-5
    assert mx.featurise(None)[1] == 0 and not mx.featurise("")[0].any()
    long = "word " * 300_000
    assert mx.featurise(long)[1] == 300_000


def test_classifier_on_held_out_rows(spark):
    docs, labels = frames(spark, rows_of(400, 1))
    model = mx.fit_domains(docs.filter("doc_id < 300"), labels)
    assert model.names == ["de:0", "de:1", "en:0", "en:1", "fr:0", "fr:1"] or len(model.names) >= 4
    rest = [r for r in rows_of(400, 1) if r[0] >= 300]
    post = model.posteriors(np.array([mx.featurise(r[1])[0] for r in rest]))
    assert np.mean([model.names[k] == f"{r[2]}:{r[3]}" for k, r in zip(post.argmax(1), rest)]) > 0.9


def test_rates_reach_targets_and_match_a_dense_solver(spark):
    docs, labels = frames(spark, rows_of(300, 2))
    model = mx.fit_domains(docs, labels)
    table = mx.with_posteriors(docs, model)
    shares = dict(zip(model.names, np.arange(1, len(model.names) + 1) / sum(range(1, len(model.names) + 1))))
    mix = mx.fit_rates(table, model, shares, steps=400, tolerance=1e-5)
    got = table.select("_tokens", "_post").collect()
    t, p = np.array([r[0] for r in got], float), np.array([r[1] for r in got], float)
    r = mix.rates(p)
    assert (r >= 0).all()
    assert np.allclose((r * t) @ p, mix.reached, rtol=1e-6)
    assert np.abs(mix.reached - mix.targets).max() < 0.02 * mix.targets.sum()
    # the same problem, plain steps without momentum over all rows at once
    slope = lambda s: p @ (mix.metric @ ((s * t) @ p - mix.targets)) + mix.ridge * (s - mix.start)
    s = np.full(len(t), mix.start)
    for _ in range(20_000):
        s = np.maximum(0, s - slope(s) / (1 + mix.ridge))
    miss = lambda r: (r * t) @ p - mix.targets
    gap = lambda r: miss(r) @ mix.metric @ miss(r) / 2 + mix.ridge / 2 * (t * (r - mix.start) ** 2).sum()
    assert gap(r) <= gap(s) * 1.05 + 1e-6


def test_copies_do_not_hang_on_the_layout(spark):
    rows = rows_of(120, 8) + [(7, "zweimal", "de", 1)] * 2 + [(None, None, None, 1)]
    docs, labels = frames(spark, rows)
    model = mx.fit_domains(docs, labels)
    seen = []
    for n in (2, 7):
        laid = docs.repartition(n)
        out = mx.mixing_table(laid, labels).collect()
        seen.append(sorted((r.doc_id or -1, r.n_tokens, r.copies, r.domain_met) for r in out))
        mixed = mx.mixed(laid, labels, least=0.5).collect()
        seen.append(sorted((r.doc_id or -1, r.text or "") for r in mixed))
    assert seen[0] == seen[2] and seen[1] == seen[3]
    assert len(model.names) > 1


def test_least_keeps_every_row(spark):
    rows = rows_of(200, 3) + [(None, None, None, 1), (7, "", "en", 1), (7, "", "en", 1)]
    docs, labels = frames(spark, rows)
    out = mx.mixed(docs, labels, power=0.6, least=1.0)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert set(got) == {(r[0], r[1]) for r in rows} and len(got) > len(rows)
    assert got.count((7, "")) >= 2


def test_table_and_empty(spark):
    docs, labels = frames(spark, rows_of(60, 4))
    out = mx.mixing_table(docs, labels).collect()
    assert len(out) == 60 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    again = mx.mixing_table(docs, labels).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mx.mixing_table(docs.limit(0), labels).collect() == []
    assert {r.domain for r in mx.mixing_table(docs, labels.limit(0)).collect()} == {"all"}


def test_rare_domains_reach_their_own_targets(spark):
    """A domain of a thousandth of the tokens is held to its own target."""
    rng = np.random.default_rng(5)
    tokens = rng.integers(50, 150, 4000)
    kind = np.where(np.arange(4000) % 1000 == 0, 2, np.arange(4000) % 3 == 0)
    post = np.full((4000, 3), 0.01)
    post[np.arange(4000), kind] = 0.98
    post[kind != 2, 2] = 1e-5
    post /= post.sum(1, keepdims=True)
    table = spark.createDataFrame([(i, i, int(t), p.tolist()) for i, (t, p) in enumerate(zip(tokens, post))],
                                  "doc_id long, _rid long, _tokens long, _post array<float>")
    model = mx.Domains(["a", "b", "rare"], np.zeros((mx.BUCKETS, 3), np.float32), np.zeros(3, np.float32))
    mix = mx.fit_rates(table, model, {"rare": 0.0018})
    assert mix.met.all() and not mix.infeasible
    assert (np.abs(mix.reached / mix.targets - 1) < 2e-3 + 1e-9).all()
    p = np.array([r[0] for r in table.orderBy("doc_id").select("_post").collect()], float)
    assert np.allclose((mix.rates(p) * tokens) @ p, mix.reached)


def test_unreachable_targets_are_proved_and_warned_of(spark):
    table = spark.createDataFrame([(i, i, 100, [0.5, 0.5] if i % 2 else [0.75, 0.25]) for i in range(40)],
                                  "doc_id long, _rid long, _tokens long, _post array<float>")
    model = mx.Domains(["a", "b"], np.zeros((mx.BUCKETS, 2), np.float32), np.zeros(2, np.float32))
    with pytest.warns(UserWarning, match="no rates can reach"):
        mix = mx.fit_rates(table, model, {"a": 0.1, "b": 0.9})
    assert mix.infeasible and not mix.met.all()
    with pytest.raises(ValueError, match="c:1"):
        mx.fit_rates(table, model, {"a": 0.5, "c:1": 0.5})


def test_rare_and_many_domains(spark):
    """Domains come from all labelled rows, however rare or many."""
    rows = rows_of(400, 6)
    rows += [(1000 + i, f"nur {i} selten", "rare", 1) for i in range(2)]
    rows += [(2000 + i, f"wort{i} " * 9, f"l{i:02}", 1) for i in range(70)]
    docs, labels = frames(spark, rows)
    model = mx.fit_domains(docs, labels, max_rows=60)
    assert model.names == sorted({f"{r[2]}:{r[3]}" for r in rows}) and len(model.names) > 64
    table = mx.with_posteriors(docs, model)
    mix = mx.fit_rates(table, model)
    assert mix.targets.shape == (len(model.names),) and (mix.targets > 0).all()
    p = model.posteriors(np.array([mx.featurise("nur 0 selten")[0]]))[0]
    assert p[model.names.index("rare:1")] > 10 * 2 / len(rows)


def test_repeated_ids_are_one_training_row(spark, monkeypatch):
    rows = rows_of(30, 7) + [(3, f"noch {i}", "en", 1) for i in range(200)]
    docs, _ = frames(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sizes = []
    plain = mx.train
    monkeypatch.setattr(mx, "train", lambda x, y, names, **k: sizes.append(len(x)) or plain(x, y, names, **k))
    model = mx.fit_domains(docs, labels)
    assert sizes == [len({(r[0], r[2]) for r in rows})] and "en:1" in model.names
