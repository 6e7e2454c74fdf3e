"""Fold-parallel pool-based selection.

All ``k`` folds run in one plan per round, keyed by a ``fold`` column
(the reference runs them one after another). Per round:

1. anchors = the ``floor(0.3 n)`` most uncertain validation ids per fold, from
   the score table that the round before left (every model scores the
   validation rows once);
2. max cosine similarity of every pool id to the fold's anchors, kept across
   rounds with the anchor that has it: a fold that rejected changes nothing, one
   that accepted compares only with its new anchors, and anew where the winning
   anchor left;
3. candidates = pool ids not yet marked useful/useless in the fold; the top
   ``k`` of them per fold, ranked on narrow rows;
4. the new model = the head extended by the selected rows;
5. accept iff the new validation F1 is strictly larger: selected ids become
   useful, useless ids are cleared, the model and its scores are kept;
   otherwise (anchor gate) a seeded half of the selection becomes useless.

A score dictionary has one entry per id, so ids are unique wherever they are
ranked or counted; training and metrics use every row of an id, as a
restriction by id does.

The model is a *head*: ``start`` (fit on a fold's training rows), ``fit`` (fit
with selected rows added), ``keep`` (per fold the new or the old model) and
``score`` (adds ``logits``). :class:`CentroidHead` is the default;
:class:`ProjectedHead` runs a user's vector model in front of it, so pool and
anchor vectors are recomputed; :class:`SoftmaxHead` trains in epochs.

State lives in tables (model, pool state, scores, anchors, similarities) in the
shared checkpoint folder, so lineage stays one round deep and a lost executor
only recomputes the current round. Scores, anchors and similarities are a folder
a fold: an accepted fold replaces its own, the others are referred to. A round's
scratch tables are removed at its end. Small actions bring per-fold counts to
the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import REAL_VALUES, encode_label
from ..functions.vectors import argmax, dot
from ..operators.epochs import CLASSES, EpochParams, fit_epochs, training_rows, weights_array, weights_table
from ..operators.folds import drop_half, kfold
from ..operators.metrics import binary_metrics, confusion_counts, metrics_from_counts
from ..operators.pool import generated_pool
from ..operators.selection import select_first
from ..operators.similarity import PackedPool, best_anchors, draw_pivots, pack_pool
from ..operators.training import (add_sums, centroids_from_sums, class_sums, kfold_sums,
                                  map_vectors, model_wide, score_centroids, with_prediction)
from ..session import FoldTables, cut_lineage, local_rows, release, scratch_scope

# --- fixed values of the reference's run ------------------------------------
K_FOLDS = 5          # folds
FOLD_SEED = 2025     # shuffle seed of the fold split
ANCHOR_SHARE = 0.3   # share of validation ids used as anchors
MIN_VOTES = 3        # folds that must accept an id
# ---------------------------------------------------------------------------


@dataclass
class ALConfig:
    """Parameters of a selection run (CLI of the reference, validated)."""
    rounds: int = 6
    pool_size: int | None = None      # ids selected per round; None -> pool_share of the pool
    pool_share: float = 0.15          # quick-start ratio: 500 of a 3,278-item pool
    k_folds: int = K_FOLDS
    seed: int = FOLD_SEED
    anchor_share: float = ANCHOR_SHARE
    min_votes: int = MIN_VOTES
    scale: float = 10.0
    anchor_gate: str = "always"       # 'always' (reference behaviour) or 'candidate'
    dataset: str = "fakett"

    def __post_init__(self):
        if self.dataset not in REAL_VALUES:
            raise ValueError(f"unknown dataset {self.dataset!r}")
        if self.anchor_gate not in ("always", "candidate"):
            raise ValueError(f"unknown anchor gate {self.anchor_gate!r}")
        if self.rounds < 0 or self.k_folds < 2:
            raise ValueError("rounds >= 0 and k_folds >= 2 required")

    def fingerprint(self) -> str:
        """The settings that a resumed run must share (not ``rounds``)."""
        return json.dumps({k: v for k, v in sorted(vars(self).items()) if k != "rounds"})


class CentroidHead:
    """Nearest centroids per fold, kept as class sums: extending adds the sums
    of the selected rows, so the training set is never scanned again."""

    def __init__(self, scale: float = 10.0):
        self.scale = scale

    def start(self, train: DataFrame, k: int) -> DataFrame:
        return kfold_sums(train, k)

    def extend(self, model: DataFrame, rows: DataFrame) -> DataFrame:
        return add_sums(model, class_sums(rows, ["fold"]), ["fold"])

    def fit(self, data: "ALData", cur: "Current", selected: DataFrame, folds: list[int]) -> DataFrame:
        """The model of each fold's training set plus its ``selected`` ids."""
        return self.extend(cur.model, selected.join(data.pool, "video_id").select("fold", "video_id", "y", "fea"))

    def fit_final(self, train: DataFrame, val: DataFrame | None) -> DataFrame:
        """One model of all of ``train`` (y, fea)."""
        return centroids_from_sums(class_sums(train))

    def score_final(self, model: DataFrame, df: DataFrame) -> DataFrame:
        return score_centroids(model, df, scale=self.scale)

    def keep(self, new: DataFrame, old: DataFrame, in_new) -> DataFrame:
        return new.filter(in_new).unionByName(old.filter(~in_new))

    def vectors(self, df: DataFrame) -> DataFrame:
        """``df`` with the vectors that similarities are taken on."""
        return df

    def score(self, model: DataFrame, df: DataFrame) -> DataFrame:
        return score_centroids(centroids_from_sums(model, ["fold"]), df, by=["fold"], scale=self.scale)

    def predict_all(self, model: DataFrame, df: DataFrame) -> DataFrame:
        """(fold, y, pred) of every row under every fold's model. The models
        (folds x classes rows) travel as one row; a row of ``df`` is read once
        and only narrow rows are multiplied."""
        wide = model_wide(centroids_from_sums(model, ["fold"]), ["fold"])
        one = wide.agg(F.collect_list(F.struct("fold", "c0", "c1")).alias("_models")).withColumn("_one", F.lit(1))
        logit = lambda c: F.coalesce(F.lit(self.scale) * dot(F.col("fea"), c), F.lit(0.0))
        scored = df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
        return scored.select("y", F.explode(F.transform("_models", lambda m: F.struct(
            m["fold"].alias("fold"), (logit(m["c1"]) > logit(m["c0"])).cast("int").alias("pred")))).alias("_p")) \
            .select("_p.fold", "y", "_p.pred")


class ProjectedHead(CentroidHead):
    """A user's vector model (``project(x) -> out`` on numpy rows) with the
    centroid head on top of its output."""

    def __init__(self, project, scale: float = 10.0, max_model_bytes: int = 64 << 20):
        super().__init__(scale)
        self.project, self.max_model_bytes = project, max_model_bytes

    def vectors(self, df: DataFrame) -> DataFrame:
        return map_vectors(df, self.project, max_model_bytes=self.max_model_bytes)


class SoftmaxHead(CentroidHead):
    """A softmax classifier trained in epochs (:mod:`..operators.epochs`).

    A round trains each fold from its accepted model on the fold's training
    ids, its useful ids and its selection, for all folds in one pass an epoch;
    the epoch with the best validation F1 is the new model. ``histories`` keeps
    one table (fold, epoch, loss, f1) a fit, as :func:`early_stop` reads it."""

    def __init__(self, params: EpochParams | None = None):
        super().__init__()
        self.params = params or EpochParams()
        self.histories: list[list[tuple]] = []

    def _fit(self, rows: DataFrame, start, folds=None):
        table = cut_lineage(rows)
        best, history = fit_epochs(table, start, self.params, folds)
        release(table)
        self.histories.append(history)
        return weights_table(rows.sparkSession, best)

    def start(self, train: DataFrame, k: int) -> DataFrame:
        return self._fit(training_rows(train, k), self._zeros(train, k))

    @staticmethod
    def _zeros(train: DataFrame, k: int):
        import numpy as np
        row = train.select(F.size("fea").alias("d")).first()
        if row is None:
            raise ValueError("no training rows")
        return np.zeros((k, CLASSES, row.d + 1))

    def fit(self, data: "ALData", cur: "Current", selected: DataFrame, folds: list[int]) -> DataFrame:
        useful = cur.state.filter(F.col("status") == "useful").select("fold", "video_id")
        start = weights_array(cur.model)
        rows = training_rows(data.train, len(start), data.pool, useful.unionByName(selected.select("fold", "video_id")))
        return self._fit(rows, start, folds)

    def fit_final(self, train: DataFrame, val: DataFrame | None) -> DataFrame:
        rows = train.select(F.array(F.lit(0)).alias("runs"), F.lit(-1).alias("val"), "y", "fea")
        held = train if val is None else val  # without a validation list the training rows judge
        rows = rows.unionByName(held.select(F.array().cast("array<int>").alias("runs"), F.lit(0).alias("val"), "y", "fea"))
        return self._fit(rows, self._zeros(train, 1))

    def score(self, model: DataFrame, df: DataFrame) -> DataFrame:
        heads = model.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("cls", "w", "b"))).alias("_w"))  # a row a fold
        out = df.join(F.broadcast(heads), "fold")
        x = F.col("fea").cast("array<double>")
        return with_prediction(out.withColumn("logits", F.transform("_w", lambda r: dot(x, r["w"]) + r["b"])).drop("_w"))

    def score_final(self, model: DataFrame, df: DataFrame) -> DataFrame:
        return self.score(model, df.withColumn("fold", F.lit(0))).drop("fold")

    def predict_all(self, model: DataFrame, df: DataFrame) -> DataFrame:
        one = model.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("cls", "w", "b"))).alias("w")) \
            .agg(F.collect_list(F.struct("fold", "w")).alias("_models")).withColumn("_one", F.lit(1))
        x = F.col("fea").cast("array<double>")
        pred = lambda m: argmax(F.transform(m["w"], lambda r: dot(x, r["w"]) + r["b"]))
        scored = df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
        return scored.select("y", F.explode(F.transform("_models", lambda m: F.struct(
            m["fold"].alias("fold"), pred(m).cast("int").alias("pred")))).alias("_p")).select("_p.fold", "y", "_p.pred")


@dataclass
class ALData:
    """Prepared inputs; every frame is read once and written."""
    train: DataFrame    # fold, video_id, y, fea  (fold = the fold the id validates)
    pool: DataFrame     # video_id, y, fea: every manifest row of the pool
    test: DataFrame     # video_id, y, fea
    init_sums: DataFrame  # model of each fold run before any selection
    k: int              # ids selected per round
    val_ids: DataFrame | None = None   # fold, video_id, fea: one row per id
    pool_ids: DataFrame | None = None  # video_id, fea: one row per id
    n_pool: int = 0     # distinct pool ids
    packed: PackedPool | None = None   # pool_ids in blocks, for the similarities of every round
    head: CentroidHead = field(default_factory=CentroidHead)


def _one_per_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """One vector per id. Rows of an id have no order in a table, so the
    largest (class, vector) stands for 'the last one'."""
    return df.groupBy(*keys).agg(F.max(F.struct("y", "fea")).alias("_r")).select(*keys, F.col("_r.fea").alias("fea"))


def prepare(items: DataFrame, train_ids: DataFrame, test_ids: DataFrame,
            exclude_seed_ids: DataFrame | None, cfg: ALConfig, head: CentroidHead | None = None) -> ALData:
    """``items``: video_id, label, source, fea (an id may have several rows)."""
    head = head or CentroidHead(cfg.scale)
    # written first: train, pool and test would each compute the items anew, however much lies behind them
    base = cut_lineage(items.select("video_id", encode_label("label", REAL_VALUES[cfg.dataset]).alias("y"),
                                    "source", F.col("fea").cast("array<double>").alias("fea")))
    folds = kfold(train_ids.select("video_id").distinct(), cfg.k_folds, cfg.seed)
    train = cut_lineage(head.vectors(base.join(folds, "video_id").select("fold", "video_id", "y", "fea")))
    pool = cut_lineage(head.vectors(generated_pool(base, exclude_seed_ids).select("video_id", "y", "fea")))
    test = cut_lineage(head.vectors(base.join(test_ids.select("video_id").distinct(), "video_id")
                                    .select("video_id", "y", "fea")))
    release(base)
    init = cut_lineage(head.start(train, cfg.k_folds))
    val_ids = cut_lineage(_one_per_id(train, ["fold", "video_id"]))
    pool_ids = cut_lineage(_one_per_id(pool, ["video_id"]))
    n_pool = pool_ids.count()
    packed = pack_pool(pool_ids, draw_pivots(val_ids))
    k = cfg.pool_size if cfg.pool_size is not None else int(_round_half_up(n_pool * cfg.pool_share))
    return ALData(train, pool, test, init, k, val_ids, pool_ids, n_pool, packed, head)


def _round_half_up(x: float) -> int:
    import math
    return int(math.floor(x + 0.5))


def val_scores(data: ALData, model: DataFrame) -> DataFrame:
    """fold, video_id, y, pred, entropy of every validation row."""
    return data.head.score(model, data.train).select("fold", "video_id", "y", "pred", "entropy")


def anchor_ids(scores: DataFrame, cfg: ALConfig) -> DataFrame:
    """fold, video_id, entropy: the ``floor(0.3 n)`` most uncertain ids
    of each fold (an id with several rows counts once)."""
    per_id = scores.groupBy("fold", "video_id").agg(F.max("entropy").alias("entropy"))
    return select_first(per_id, F.col("entropy"), ["video_id"], ["fold"], share=cfg.anchor_share, descending=True)


def round_anchors(data: ALData, sums: DataFrame, cfg: ALConfig, scores: DataFrame | None = None) -> DataFrame:
    """The anchors with their vectors: selected narrow, joined after."""
    ids = anchor_ids(val_scores(data, sums) if scores is None else scores, cfg)
    return ids.join(data.val_ids, ["fold", "video_id"])


def _named(anchors: DataFrame) -> DataFrame:
    """Anchors as :func:`best_anchors` reads them."""
    return anchors.select(F.col("fold").cast("string").alias("grp"), F.col("video_id").alias("id"), F.col("fea").alias("vec"))


def _per_fold(found: DataFrame) -> DataFrame:
    return found.select(F.col("grp").cast("int").alias("fold"), F.col("id").alias("video_id"), F.col("sim").alias("similarity"),
                        F.col("name").alias("anchor"))


def round_similarity(data: ALData, anchors: DataFrame, state: DataFrame, cfg: ALConfig,
                     folds: list[int] | None = None) -> DataFrame:
    """Max cosine similarity of every candidate of every fold to the fold's
    anchors, computed anew: fold, video_id, similarity, anchor."""
    folds = list(range(cfg.k_folds)) if folds is None else folds
    found = _per_fold(best_anchors(data.packed, _named(anchors), [str(f) for f in folds]))
    return found.join(state.select("fold", "video_id"), ["fold", "video_id"], "left_anti")


@dataclass
class Current:
    """What a round starts from: the model, the pool state, each fold's score
    table and the figures of the current model. ``anchors`` and ``sims`` (the
    maximum of every pool id and the anchor that has it) are kept across
    rounds; ``stale`` are the folds whose scores changed since."""
    model: DataFrame
    state: DataFrame
    scores: FoldTables
    f1: dict[int, tuple[float | None, float | None]]  # fold: validation, test
    anchors: FoldTables | None = None
    sims: FoldTables | None = None
    stale: frozenset[int] = frozenset()


#: Beyond this share of rows to be compared anew, all are.
ANEW_SHARE = 0.5


def similarities(data: ALData, cur: Current, cfg: ALConfig) -> tuple[FoldTables, FoldTables]:
    """(anchors, sims) of the current models. A fold whose model stayed keeps
    both tables. In the others a maximum whose anchor is still an anchor only
    meets the new anchors; only ids whose anchor left are compared with all."""
    stale = sorted(cur.stale)
    if cur.sims is not None and not stale:
        return cur.anchors, cur.sims
    fresh = FoldTables.write(anchor_ids(cur.scores.frame(stale), cfg), "anchors")
    now = fresh.frame(stale)
    vectors = lambda ids: ids.select("fold", "video_id").join(data.val_ids, ["fold", "video_id"])
    groups = [str(f) for f in stale]
    if cur.sims is None:
        return fresh, FoldTables.write(_per_fold(best_anchors(data.packed, _named(vectors(now)), groups)), "similarity")
    before, keys = cur.anchors.frame(stale), ["fold", "video_id"]
    left = before.select(*keys).join(now, keys, "left_anti")
    added = now.select(*keys).join(before, keys, "left_anti")
    gone = left.select("fold", F.col("video_id").alias("anchor")).withColumn("_lost", F.lit(True))
    held = cur.sims.frame(stale).join(gone, ["fold", "anchor"], "left").withColumn(
        "_lost", F.coalesce("_lost", F.col("anchor").isNull()))
    held = cut_lineage(held.select("fold", "video_id", "similarity", "anchor", "_lost"))
    n, lost = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_lost").cast("long")), F.lit(0))).first()
    if lost > ANEW_SHARE * n:
        out = _per_fold(best_anchors(data.packed, _named(vectors(now)), groups))
    else:
        met = _per_fold(best_anchors(data.packed, _named(vectors(added)), groups))
        met = met.select(*keys, F.struct("similarity", "anchor").alias("_new"))
        out = held.filter(~F.col("_lost")).join(met, keys).select(
            *keys, F.greatest(F.struct("similarity", "anchor"), "_new").alias("_b")).select(*keys, "_b.similarity", "_b.anchor")
        if lost:
            again = held.filter("_lost").groupBy("video_id").agg(F.collect_set(F.col("fold").cast("string")).alias("_open"))  # at most k folds an id
            packed = pack_pool(again.join(data.pool_ids, "video_id"), data.packed.pivots, open_col="_open")
            redone = _per_fold(best_anchors(packed, _named(vectors(now)), groups))
            out = out.unionByName(redone)
    sims = FoldTables.write(out, "similarity")
    return cur.anchors.replaced(fresh, stale), cur.sims.replaced(sims, stale)


def begin(data: ALData, cfg: ALConfig, model: DataFrame | None = None, state: DataFrame | None = None) -> Current:
    model = data.init_sums if model is None else model
    scores = FoldTables.write(val_scores(data, model), "scores")
    return Current(model, empty_state(data.train.sparkSession) if state is None else state, scores,
                   _f1s(data, model, scores.frame()), stale=frozenset(range(cfg.k_folds)))


def _f1s(data: ALData, model: DataFrame, scores: DataFrame, *more) -> dict:
    """Per fold the macro F1 of validation and test rows (and what ``more``
    aggregates say), in one grouped pass over narrow rows."""
    rows = scores.select("fold", "y", "pred", F.lit("v").alias("part")).unionByName(
        data.head.predict_all(model, data.test).select("fold", "y", "pred", F.lit("t").alias("part")))
    m = confusion_counts(rows, "y", "pred", ["fold", "part"]).select("fold", "part", metrics_from_counts()["f1"].alias("f1"))
    out: dict[int, list] = {}
    for r in m.collect():
        out.setdefault(r.fold, [None, None])[r.part == "t"] = r.f1
    return {f: tuple(v) for f, v in out.items()}


def al_round(data: ALData, cur: Current, iteration: int, cfg: ALConfig,
             folds: list[int] | None = None) -> dict:
    """One round for all folds. Returns the selection and the new model and
    scores (written), and the decisions (k rows, also as ``decision_rows``)."""
    spark = data.train.sparkSession
    folds = list(range(cfg.k_folds)) if folds is None else folds
    with scratch_scope(spark) as keep:
        anchors, sims = similarities(data, cur, cfg)
        cur = replace(cur, anchors=anchors, sims=sims, stale=frozenset())
        open_ids = sims.frame(folds).join(cur.state.select("fold", "video_id"), ["fold", "video_id"], "left_anti")
        selected = select_first(open_ids.select("fold", "video_id", "similarity"), F.col("similarity"), ["video_id"], ["fold"],
                                k=data.k, descending=True)
        selected = cut_lineage(selected.withColumn("iteration", F.lit(iteration)))
        new_model = cut_lineage(data.head.fit(data, cur, selected, folds))
        new_scores = FoldTables.write(val_scores(data, new_model), "scores")
        f1 = _f1s(data, new_model, new_scores.frame())
        gates = _anchor_gates(anchors.frame(), cur.scores.frame(), new_scores.frame()) if cfg.anchor_gate == "candidate" else {}
        counts = cur.state.select("fold", F.lit(True).alias("used")).unionByName(selected.select("fold", F.lit(False).alias("used")))
        n_rows = {(r.fold, r.used): r.n for r in counts.groupBy("fold", "used").agg(F.count(F.lit(1)).alias("n")).collect()}
        keep(selected, new_model, *[list(t.paths.values()) for t in (anchors, sims, new_scores)])
    out = []
    for fold in folds:
        (old, old_test), (new, new_test) = cur.f1.get(fold, (None, None)), f1.get(fold, (None, None))
        n = data.n_pool - n_rows.get((fold, True), 0)
        accepted = bool(n > 0 and new > old) if None not in (new, old) else None
        out.append((fold, old, new, old_test, new_test, n_rows.get((fold, False), 0), n, iteration, accepted, gates.get(fold, True)))
    schema = ("fold int, cur_f1 double, new_f1 double, cur_test_f1 double, new_test_f1 double, n_selected long, n_candidates long, "
              "iteration int, accepted boolean, gate boolean")
    names = [c.split()[0] for c in schema.split(", ")]
    return {"selected": selected, "decisions": spark.createDataFrame(out, schema), "decision_rows": [dict(zip(names, r)) for r in out],
            "new_model": new_model, "new_scores": new_scores, "new_f1": f1, "anchors": anchors.frame(), "current": cur}


def _anchor_gates(anchors: DataFrame, old: DataFrame, new: DataFrame) -> dict[int, bool]:
    """Per fold: the new model is no better on the anchors than the old."""
    flags = anchors.select("fold", "video_id")
    both = old.select("fold", "video_id", "y", "pred", F.lit("o").alias("part")).unionByName(
        new.select("fold", "video_id", "y", "pred", F.lit("n").alias("part"))).join(flags, ["fold", "video_id"], "left_semi")
    m = confusion_counts(both, "y", "pred", ["fold", "part"]).select("fold", "part", metrics_from_counts()["f1"].alias("f1"))
    f1 = {(r.fold, r.part): r.f1 for r in m.collect()}
    return {f: f1[(f, "n")] <= f1[(f, "o")] for f, p in f1 if p == "n"}


def apply_decision(rnd: dict, cfg: ALConfig, head: CentroidHead | None = None) -> Current:
    """The next round's start after the accept / reject decisions. The k
    decision rows are on the driver, so the update is literal fold filters
    and unions (no joins), written to cut lineage."""
    cur, rows = rnd["current"], rnd["decision_rows"]
    head = head or CentroidHead(cfg.scale)
    acc = [r["fold"] for r in rows if r["accepted"]]
    rej = [r["fold"] for r in rows if not r["accepted"] and r["gate"]]
    in_acc = F.col("fold").isin(acc) if acc else F.lit(False)
    in_rej = F.col("fold").isin(rej) if rej else F.lit(False)
    # accept clears the fold's useless ids and keeps its useful ones
    kept = cur.state.filter(~in_acc | (F.col("status") == "useful"))
    sel = rnd["selected"].select("fold", "video_id", "iteration")
    useful = sel.filter(in_acc).withColumn("status", F.lit("useful"))
    dropped = drop_half(sel.filter(in_rej), cfg.seed).withColumn("status", F.lit("useless"))
    cols = ["fold", "video_id", "status", "iteration"]
    with scratch_scope(cur.state.sparkSession) as keep:
        state = cut_lineage(kept.select(*cols).unionByName(useful.select(*cols)).unionByName(dropped.select(*cols)))
        keep(state)
    if not acc:
        return replace(cur, state=state)
    model = cut_lineage(head.keep(rnd["new_model"], cur.model, in_acc))
    return replace(cur, model=model, state=state, scores=cur.scores.replaced(rnd["new_scores"], acc),
                   f1={**cur.f1, **{f: rnd["new_f1"][f] for f in acc}}, stale=frozenset(acc))


def empty_state(spark) -> DataFrame:
    from ..schemas import POOL_STATE
    return local_rows(spark, [], POOL_STATE)


def al_loop(data: ALData, cfg: ALConfig, rounds: int | None = None,
            state_dir: str | None = None, ids_path: str | None = None) -> dict[str, DataFrame]:
    """``rounds`` rounds for all folds. Returns the final state, the final
    model, the per-round decisions and the per-round selections.

    With ``state_dir`` (a shared folder), every round's model, pool state,
    decisions and selections are written as tables under
    ``<state_dir>/<table>/iteration=<r>`` and read back, and a round is marked
    complete, with the run's settings, only after all four are written. A
    restarted run resumes after the last complete round; other settings, or a
    gap in the rounds, are an error. With ``ids_path`` the ids accepted in each
    round are recorded there by fold and round (idempotent)."""
    from ..sources.io import append_ids

    rounds = cfg.rounds if rounds is None else rounds
    spark = data.train.sparkSession
    cur, start = None, 0
    decisions, selections = [], []
    if state_dir:
        done = completed_rounds(spark, state_dir, cfg)
        if done:
            last = min(done, rounds) - 1
            decisions = [_read_round(spark, state_dir, "decisions", r) for r in range(last + 1)]
            selections = [_read_round(spark, state_dir, "selections", r) for r in range(last + 1)]
            cur = begin(data, cfg, _read_round(spark, state_dir, "model", last), _read_round(spark, state_dir, "state", last))
            start = last + 1
    cur = cur or begin(data, cfg)
    for it in range(start, rounds):
        rnd = al_round(data, cur, it, cfg)
        after = apply_decision(rnd, cfg, data.head)
        dec, sel = rnd["decisions"], rnd["selected"]
        if ids_path:
            acc = [r["fold"] for r in rnd["decision_rows"] if r["accepted"]]
            if acc:
                append_ids(sel.filter(F.col("fold").isin(acc)).select("fold", "iteration", "video_id"), ids_path)
        if state_dir:
            for name, df in (("model", after.model), ("state", after.state), ("decisions", dec), ("selections", sel)):
                _write_round(state_dir, name, it, df)
            dec, sel = (_read_round(spark, state_dir, name, it) for name in ("decisions", "selections"))
            spark.createDataFrame([(it, cfg.fingerprint())], "iteration int, config string") \
                .write.mode("append").parquet(f"{state_dir}/done")
        for old, new in ((rnd["new_model"], after.model), (cur.model, after.model), (cur.state, after.state)):
            if old is not new and old is not data.init_sums:
                release(old)
        for old in (rnd["new_scores"], cur.scores, cur.anchors, cur.sims):
            if old is not None:
                old.release(after.scores, after.anchors, after.sims)
        decisions.append(dec)
        selections.append(sel)
        cur = after
    dec = _union(decisions) if decisions else None
    sel = _union(selections) if selections else None
    return {"state": cur.state, "sums": cur.model, "decisions": dec, "selections": sel}


def completed_rounds(spark, state_dir: str, cfg: ALConfig) -> int:
    """How many rounds a state folder holds: 0 if it is not there yet."""
    try:
        rows = spark.read.parquet(f"{state_dir}/done").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    if {r.config for r in rows} != {cfg.fingerprint()}:
        raise ValueError("the state folder belongs to a run with other settings")
    seen = sorted({r.iteration for r in rows})
    if seen != list(range(len(seen))):
        raise ValueError(f"rounds are missing in the state folder: it has {seen}")
    return len(seen)


def _write_round(state_dir: str, name: str, it: int, df: DataFrame) -> None:
    df.write.mode("overwrite").parquet(f"{state_dir}/{name}/iteration={it}")


def _read_round(spark, state_dir: str, name: str, it: int) -> DataFrame:
    return spark.read.parquet(f"{state_dir}/{name}/iteration={it}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def majority_vote(state: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """Ids marked useful in at least ``min_votes`` folds: video_id, votes.
    A partial + final hash aggregate on the id."""
    useful = state.filter(F.col("status") == "useful")
    return (useful.groupBy("video_id").agg(F.count_distinct("fold").alias("votes"))
            .filter(F.col("votes") >= min_votes))


def final_train(data: ALData, voted: DataFrame) -> DataFrame:
    """Original training ids ∪ voted pool ids (bag union): video_id, y, fea."""
    base = data.train.select("video_id", "y", "fea")
    extra = data.pool.join(voted.select("video_id"), "video_id", "left_semi")
    return base.unionByName(extra)


def cross_validated_selection(data: ALData, cfg: ALConfig, val: DataFrame | None = None,
                              ids_path: str | None = None, accepted_path: str | None = None,
                              state_dir: str | None = None) -> dict[str, DataFrame]:
    """K5 per fold (fold-parallel) -> majority vote -> final training set ->
    final model -> test metrics, and metrics on the original validation list
    ``val`` (video_id, y, fea). The voted ids replace the table at ``ids_path``;
    each fold's accepted ids are recorded by round at ``accepted_path``. With
    ``state_dir`` a run that was ended goes on after its last whole round."""
    from ..sources.io import overwrite_ids

    loop = al_loop(data, cfg, state_dir=state_dir, ids_path=accepted_path)
    voted = majority_vote(loop["state"], cfg.min_votes)
    train = final_train(data, voted)
    model = data.head.fit_final(train, val)
    metrics = {"test_metrics": binary_metrics(data.head.score_final(model, data.test), "y", "pred")}
    if val is not None:
        metrics["val_metrics"] = binary_metrics(data.head.score_final(model, val), "y", "pred")
    if ids_path:
        overwrite_ids(voted, ids_path)
    return {**loop, "voted": voted, "final_train": train, **metrics}
