import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from poolwise.plans import active_learning as al
from poolwise.plans import fixtures as fx
from poolwise.sources import io


@pytest.fixture(scope="module")
def loop(spark):
    items = fx.fx_items(spark, SF001)
    train_ids = items.filter("split = 'train'").select("video_id")
    test_ids = items.filter("split = 'test'").select("video_id")
    cfg = al.ALConfig(rounds=6)
    data = al.prepare(items, train_ids, test_ids, fx.fx_seed_ids(spark, SF001), cfg)
    return data, cfg, al.al_loop(data, cfg)


def test_decisions_match_fixture_table(loop):
    """FIXTURES.md: sf0.001, folds of 47, k = 20."""
    data, _, out = loop
    assert data.k == 20
    pat = {}
    for r in out["decisions"].orderBy("fold", "iteration").collect():
        pat[r.fold] = pat.get(r.fold, "") + ("A" if r.accepted else "r")
    assert pat == {0: "rrrrrr", 1: "rArArr", 2: "rrrrrA", 3: "ArrArr", 4: "Arrrrr"}
    st = out["state"]
    assert st.filter("status = 'useful'").select("video_id").distinct().count() == 91
    assert al.majority_vote(st).count() == 2


def test_selection_invariants(loop):
    data, cfg, out = loop
    sel = out["selections"].collect()
    dec = {(r.fold, r.iteration): r.accepted for r in out["decisions"].collect()}
    useful = {}
    for it in range(cfg.rounds):
        for r in [s for s in sel if s.iteration == it]:
            # an id accepted earlier in the fold is never selected again
            assert r.video_id not in useful.get(r.fold, set())
        for f in range(cfg.k_folds):
            if dec[(f, it)]:
                useful.setdefault(f, set()).update(s.video_id for s in sel if s.fold == f and s.iteration == it)
    final_useful = {(r.fold, r.video_id) for r in out["state"].filter("status = 'useful'").collect()}
    assert final_useful == {(f, v) for f, vs in useful.items() for v in vs}
    # a fold's useless ids all come from rejections after its last acceptance
    for r in out["state"].filter("status = 'useless'").collect():
        later_accept = [it for it in range(r.iteration + 1, cfg.rounds) if dec[(r.fold, it)]]
        assert not dec[(r.fold, r.iteration)] and not later_accept
    voted = {r.video_id for r in al.majority_vote(out["state"]).collect()}
    assert voted <= {v for vs in useful.values() for v in vs}


def test_config_validation():
    with pytest.raises(ValueError):
        al.ALConfig(dataset="unknown")
    with pytest.raises(ValueError):
        al.ALConfig(anchor_gate="sometimes")


def _tiny(spark, n_pool):
    import numpy as np
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):  # human training ids, two classes
        y = i % 2
        v = rng.normal(size=4) + (2.0 if y else -2.0)
        rows.append((f"h{i:02d}", "fake" if y else "real", "Human", [float(x) for x in v], "train"))
    for i in range(n_pool):  # generated pool items, all fake
        rows.append((f"g{i:02d}_TOVO_TOVM", "fake", "Generated_TOVO_TOVM",
                     [float(x) for x in rng.normal(size=4) + 1.0], "gen"))
    items = spark.createDataFrame(rows, "video_id string, label string, source string, fea array<double>, split string")
    return items, items.filter("split = 'train'").select("video_id")


def test_pool_exhaustion_stops_fold(spark):
    """A pool smaller than k is taken whole; once every item is useful or
    useless the fold has no candidates and nothing changes any more."""
    items, train_ids = _tiny(spark, 3)
    cfg = al.ALConfig(rounds=4, pool_size=5, k_folds=2)
    data = al.prepare(items, train_ids, train_ids.limit(0), None, cfg)
    out = al.al_loop(data, cfg)
    dec = sorted(out["decisions"].collect(), key=lambda r: (r.fold, r.iteration))
    for f in range(2):
        rows = [r for r in dec if r.fold == f]
        assert rows[0].n_candidates == 3 and rows[0].n_selected == 3
        for a, b in zip(rows, rows[1:]):
            if a.n_candidates == 0:  # stopped: stays stopped, never accepts
                assert b.n_candidates == 0 and not b.accepted
        assert all(r.n_selected <= r.n_candidates for r in rows)
    st = out["state"].collect()
    assert all(r.video_id.startswith("g") for r in st)


def test_candidate_gate_runs(spark):
    items = fx.fx_items(spark, SF001)
    cfg = al.ALConfig(rounds=2, anchor_gate="candidate")
    data = al.prepare(items, items.filter("split = 'train'").select("video_id"),
                      items.filter("split = 'test'").select("video_id"), fx.fx_seed_ids(spark, SF001), cfg)
    out = al.al_loop(data, cfg)
    dec = out["decisions"].collect()
    assert len(dec) == 10 and all(r.gate is not None for r in dec)
    # useless rows only come from rejected rounds whose gate held
    gates = {(r.fold, r.iteration): (r.accepted, r.gate) for r in dec}
    for r in out["state"].filter("status = 'useless'").collect():
        acc, gate = gates[(r.fold, r.iteration)]
        assert not acc and gate


SLOW = pytest.mark.skipif(not os.environ.get("POOLWISE_SLOW"), reason="set POOLWISE_SLOW=1")


@pytest.mark.parametrize("sf,k,pattern,anywhere,voted", [
    ("/root/testdata/sf0.01", 20, {0: "AArrrr", 1: "rrrrrr", 2: "rrrArr", 3: "rArArA", 4: "rrrrrA"}, 96, 5),
    pytest.param("/root/testdata/sf0.1", 80, {0: "rrrrrA", 1: "rrrrAr", 2: "rrrAAr", 3: "rrrrrr", 4: "rrrrrr"}, 257, 8, marks=SLOW),
])
def test_fixture_table_other_scales(spark, sf, k, pattern, anywhere, voted):
    items = fx.fx_items(spark, sf)
    cfg = al.ALConfig(rounds=6)
    data = al.prepare(items, items.filter("split = 'train'").select("video_id"),
                      items.filter("split = 'test'").select("video_id"), fx.fx_seed_ids(spark, sf), cfg)
    out = al.al_loop(data, cfg)
    got = {}
    for r in out["decisions"].orderBy("fold", "iteration").collect():
        got[r.fold] = got.get(r.fold, "") + ("A" if r.accepted else "r")
    assert data.k == k and got == pattern
    st = out["state"]
    assert st.filter("status = 'useful'").select("video_id").distinct().count() == anywhere
    assert al.majority_vote(st).count() == voted


def test_loop_resumes_from_written_rounds(spark, loop, tmpdir_path):
    """Two rounds written, then a 6-round run on the same folder resumes at
    round 2 and ends exactly where the uninterrupted run ended."""
    data, cfg, out = loop
    state_dir = tmpdir_path + "/al"
    al.al_loop(data, cfg, rounds=2, state_dir=state_dir)
    resumed = al.al_loop(data, cfg, rounds=6, state_dir=state_dir)
    norm = lambda df: sorted(tuple(r) for r in df.select("fold", "video_id", "status", "iteration").collect())
    assert norm(resumed["state"]) == norm(out["state"])
    dec = lambda df: sorted((r.fold, r.iteration, r.accepted) for r in df.collect())
    assert dec(resumed["decisions"]) == dec(out["decisions"])


def test_resume_refuses_other_settings_and_gaps(spark, loop, tmpdir_path):
    data, cfg, _ = loop
    state_dir = tmpdir_path + "/al"
    assert al.completed_rounds(spark, state_dir, cfg) == 0
    al.al_loop(data, cfg, rounds=1, state_dir=state_dir)
    assert al.completed_rounds(spark, state_dir, cfg) == 1
    with pytest.raises(ValueError, match="other settings"):
        al.al_loop(data, al.ALConfig(seed=7), rounds=2, state_dir=state_dir)
    spark.createDataFrame([(5, cfg.fingerprint())], "iteration int, config string").write.mode("append").parquet(f"{state_dir}/done")
    with pytest.raises(ValueError, match="missing"):
        al.al_loop(data, cfg, rounds=7, state_dir=state_dir)
    broken = tmpdir_path + "/broken"
    os.makedirs(f"{broken}/done")
    with open(f"{broken}/done/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # damage is not taken for 'no round yet'
        al.completed_rounds(spark, broken, cfg)


def test_an_id_with_two_rows_is_chosen_once(spark):
    items, train_ids = _tiny(spark, 8)
    twice = items.unionByName(items.filter("video_id IN ('g00_TOVO_TOVM', 'g01_TOVO_TOVM', 'g02_TOVO_TOVM', 'g03_TOVO_TOVM')"))
    cfg = al.ALConfig(rounds=1, pool_size=4, k_folds=2)
    data = al.prepare(twice, train_ids, train_ids.limit(0), None, cfg)
    assert data.n_pool == 8 and data.pool.count() == 12
    rnd = al.al_round(data, al.begin(data, cfg), 0, cfg)
    for f in range(2):
        ids = [r.video_id for r in rnd["selected"].filter(f"fold = {f}").collect()]
        assert len(ids) == len(set(ids)) == 4
    assert all(r["n_candidates"] == 8 for r in rnd["decision_rows"])


def test_selected_rows_move_no_vectors_and_nothing_is_collected(spark, loop):
    """The ranks of a round see ids and numbers only."""
    data, cfg, _ = loop
    cur = al.begin(data, cfg)
    plan = al.anchor_ids(cur.scores.frame(), cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert "fea" not in plan


def test_projected_head_equals_projected_items(spark):
    import numpy as np
    from poolwise.plans.queries import half_difference

    items, train_ids = _tiny(spark, 12)
    cfg = al.ALConfig(rounds=2, pool_size=3, k_folds=2)
    data = al.prepare(items, train_ids, train_ids.limit(5), None, cfg, al.ProjectedHead(half_difference, cfg.scale))
    rows = [(r.video_id, r.label, r.source, half_difference(np.array([r.fea]))[0].tolist()) for r in items.collect()]
    plain = spark.createDataFrame(rows, "video_id string, label string, source string, fea array<double>")
    other = al.prepare(plain, train_ids, train_ids.limit(5), None, cfg)
    norm = lambda out: sorted(map(tuple, out["state"].collect()))
    assert norm(al.al_loop(data, cfg)) == norm(al.al_loop(other, cfg))
    with pytest.raises(ValueError, match="bytes"):
        al.ProjectedHead(half_difference, max_model_bytes=10).vectors(plain.select("video_id", "fea"))


def test_final_fit_reports_validation_and_writes_ids(spark, tmpdir_path):
    items, train_ids = _tiny(spark, 10)
    cfg = al.ALConfig(rounds=2, pool_size=3, k_folds=2, min_votes=1)
    data = al.prepare(items, train_ids, train_ids.limit(6), None, cfg)
    val = data.test.select("video_id", "y", "fea")
    out = al.cross_validated_selection(data, cfg, val, ids_path=tmpdir_path + "/voted")
    assert out["val_metrics"].collect() == out["test_metrics"].collect()
    assert io.read_version(spark, tmpdir_path + "/voted").count() == out["voted"].count()


def _files(table):
    return {f: sorted(os.listdir(p.split(":", 1)[-1])) for f, p in table.paths.items()}


def test_rounds_copy_only_accepted_folds_and_leave_no_scratch(spark, loop):
    """A fold that rejects keeps its score, anchor and similarity files."""
    data, cfg, _ = loop
    cur = al.begin(data, cfg)
    root = spark.sparkContext.getCheckpointDir().split(":", 1)[-1] + "/poolwise"
    seen = 0
    for it in range(3):
        before = set(os.listdir(root))
        rnd = al.al_round(data, cur, it, cfg)
        acc = {r["fold"] for r in rnd["decision_rows"] if r["accepted"]}
        mid, after = rnd["current"], al.apply_decision(rnd, cfg, data.head)
        for f in range(cfg.k_folds):
            same = mid.scores.paths[f] == after.scores.paths[f]
            assert same == (f not in acc)
        if cur.sims is not None:
            for f in set(range(cfg.k_folds)) - set(cur.stale):
                assert mid.sims.paths[f] == cur.sims.paths[f] and mid.anchors.paths[f] == cur.anchors.paths[f]
                seen += 1
        made = set(os.listdir(root)) - before  # what the round has left behind
        assert len(made) <= 8, made
        assert all(_files(after.scores).values())
        cur = after
    assert seen


def test_kept_similarities_equal_new_ones(spark, loop):
    """Maxima kept across rounds against a full computation, fold by fold."""
    data, cfg, _ = loop
    cur, accepted = al.begin(data, cfg), 0
    for it in range(5):
        rnd = al.al_round(data, cur, it, cfg)
        mid = rnd["current"]
        anchors = al.anchor_ids(mid.scores.frame(), cfg).join(data.val_ids, ["fold", "video_id"])
        full = al.round_similarity(data, anchors, al.empty_state(spark), cfg)
        norm = lambda df: sorted((r.fold, r.video_id, round(r.similarity, 12)) for r in df.collect())
        assert norm(mid.sims.frame()) == norm(full)
        accepted += sum(bool(r["accepted"]) for r in rnd["decision_rows"])
        cur = al.apply_decision(rnd, cfg, data.head)
    assert accepted


@pytest.mark.parametrize("anew", [0.0, 1.0])
def test_lost_maxima_are_found_again(spark, loop, monkeypatch, anew):
    """Both ways of renewing a changed fold: anew for all, or for the lost."""
    data, cfg, out = loop
    monkeypatch.setattr(al, "ANEW_SHARE", anew)
    got = al.al_loop(data, cfg, rounds=4)
    dec = lambda df: sorted((r.fold, r.iteration, r.accepted) for r in df.collect() if r.iteration < 4)
    assert dec(got["decisions"]) == dec(out["decisions"])


def test_a_run_that_dies_resumes_as_a_whole(spark, loop, tmpdir_path, monkeypatch):
    data, cfg, out = loop
    val = data.test.select("video_id", "y", "fea")
    whole = al.cross_validated_selection(data, cfg, val)
    real, calls = al.al_round, []

    def dying(*args, **kw):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(*args, **kw)

    monkeypatch.setattr(al, "al_round", dying)
    paths = dict(state_dir=tmpdir_path + "/state", accepted_path=tmpdir_path + "/accepted", ids_path=tmpdir_path + "/voted")
    with pytest.raises(RuntimeError, match="lost"):
        al.cross_validated_selection(data, cfg, val, **paths)
    monkeypatch.setattr(al, "al_round", real)
    again = al.cross_validated_selection(data, cfg, val, **paths)
    assert sorted(map(tuple, again["state"].collect())) == sorted(map(tuple, whole["state"].collect()))
    assert again["test_metrics"].collect() == whole["test_metrics"].collect()
    accepted = {(r.fold, r.iteration) for r in out["decisions"].collect() if r.accepted}
    assert {(r.fold, r.iteration) for r in io.read_version(spark, tmpdir_path + "/accepted").collect()} == accepted
