"""SQL text (DuckDB dialect) of the selection loop, for oracle checks.

The Spark plans never run this; it restates the loop set-wise so the driver
can compare results: centroids as per-dimension averages, dot products as
joins on the dimension, F1 from counts, anchors / top-k with window ranks,
similarity as a join of pool and anchor rows reduced by ``max``. A round is a
block of CTEs generated from a template; ``r`` rounds are ``r`` blocks.
"""

from __future__ import annotations

from .fixtures import FX_ITEMS_SQL

SCALE = 10.0
ANCHOR_SHARE = 0.3
POOL_SHARE = 0.15
K_FOLDS = 5
SEED = 2025

BASE = FX_ITEMS_SQL + f""",
items AS (
  SELECT video_id, vec_id, split, source, CASE WHEN label = 'real' THEN 0 ELSE 1 END AS y, fea
  FROM fx_items),
folds AS (
  SELECT video_id,
    CAST(ntile({K_FOLDS}) OVER (ORDER BY md5('{SEED}:' || video_id), video_id) - 1 AS INTEGER) AS fold
  FROM items WHERE split = 'train'),
runs AS (SELECT CAST(range AS INTEGER) AS run FROM range({K_FOLDS})),
train AS (SELECT f.fold, i.video_id, i.y, i.fea FROM items i JOIN folds f USING (video_id)),
train_dims AS (
  SELECT fold, video_id, y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d FROM train),
test_dims AS (
  SELECT video_id, y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d FROM items WHERE split = 'test'),
pool AS (
  SELECT video_id, y, fea FROM items
  WHERE source IS DISTINCT FROM 'Human'
    AND split_part(video_id, '_', 1) NOT IN (SELECT video_id FROM items WHERE vec_id % 15 = 13)),
pool_dims AS (SELECT video_id, y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d FROM pool),
kpar AS (SELECT CAST(floor(count(*) * {POOL_SHARE} + 0.5) AS BIGINT) AS k FROM pool),
model_0 AS (
  SELECT r.run AS fold, t.y, t.d, sum(t.v) AS s, count(*) AS c
  FROM train_dims t JOIN runs r ON t.fold <> r.run GROUP BY r.run, t.y, t.d),
state_0 AS (
  SELECT CAST(NULL AS INTEGER) AS fold, CAST(NULL AS VARCHAR) AS video_id,
         CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INTEGER) AS iteration WHERE false)"""


def _score(name: str, model: str) -> str:
    """Scores of every fold's validation rows under ``model`` (fold, y, d, s, c)."""
    return f""",
{name}_dot AS (
  SELECT t.fold, t.video_id, t.y, m.y AS cls, sum(t.v * (m.s / m.c)) AS dp
  FROM train_dims t JOIN {model} m ON t.fold = m.fold AND t.d = m.d
  GROUP BY t.fold, t.video_id, t.y, m.y),
{name}_l AS (
  SELECT t.fold, t.video_id, t.y,
    coalesce({SCALE} * max(CASE WHEN cls = 0 THEN dp END), 0.0) AS l0,
    coalesce({SCALE} * max(CASE WHEN cls = 1 THEN dp END), 0.0) AS l1
  FROM train t LEFT JOIN {name}_dot USING (fold, video_id, y) GROUP BY t.fold, t.video_id, t.y),
{name} AS (
  SELECT fold, video_id, y, l0, l1,
    CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred,
    exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p0,
    exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p1
  FROM {name}_l),
{name}_f1 AS (
  SELECT fold, {f1_expr('y', 'pred')} AS f1 FROM {name} GROUP BY fold)"""


def _score_test(name: str, model: str) -> str:
    """Test F1 of every fold's ``model`` (reported, never decides)."""
    return f""",
{name}_dot AS (
  SELECT m.fold, t.video_id, t.y, m.y AS cls, sum(t.v * (m.s / m.c)) AS dp
  FROM test_dims t JOIN {model} m ON t.d = m.d GROUP BY m.fold, t.video_id, t.y, m.y),
{name} AS (
  SELECT fold, video_id, y,
    CASE WHEN coalesce({SCALE} * max(CASE WHEN cls = 1 THEN dp END), 0.0)
            > coalesce({SCALE} * max(CASE WHEN cls = 0 THEN dp END), 0.0) THEN 1 ELSE 0 END AS pred
  FROM {name}_dot GROUP BY fold, video_id, y),
{name}_f1 AS (SELECT fold, {f1_expr('y', 'pred')} AS f1 FROM {name} GROUP BY fold)"""


def f1_expr(y: str, p: str) -> str:
    """Macro F1 over the classes present in truth or prediction."""
    c = lambda a, b: f"sum(CASE WHEN {y} = {a} AND {p} = {b} THEN 1 ELSE 0 END)"
    c00, c01, c10, c11 = c(0, 0), c(0, 1), c(1, 0), c(1, 1)
    f0 = f"(CASE WHEN 2*{c00}+{c10}+{c01} > 0 THEN 2.0*{c00} / (2*{c00}+{c10}+{c01}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN 2*{c11}+{c01}+{c10} > 0 THEN 2.0*{c11} / (2*{c11}+{c01}+{c10}) ELSE 0.0 END)"
    pr0 = f"({c00}+{c01}+{c10} > 0)"
    pr1 = f"({c11}+{c01}+{c10} > 0)"
    return (f"(CASE WHEN {pr0} AND {pr1} THEN ({f0} + {f1}) / 2.0 WHEN {pr0} THEN {f0} "
            f"WHEN {pr1} THEN {f1} END)")


def selection_sql(r: int) -> str:
    """Anchors, candidates, similarities and the selection of round ``r`` from
    the scores val_r."""
    ent = "-(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10))"
    return f""",
anc_{r} AS (
  SELECT fold, video_id FROM (
    SELECT fold, video_id,
      row_number() OVER (PARTITION BY fold ORDER BY {ent} DESC, video_id) AS rn,
      count(*) OVER (PARTITION BY fold) AS nf
    FROM val_{r}) WHERE rn <= floor(nf * {ANCHOR_SHARE})),
cand_{r} AS (
  SELECT r.run AS fold, p.video_id FROM pool p CROSS JOIN runs r
  WHERE NOT EXISTS (SELECT 1 FROM state_{r} s WHERE s.fold = r.run AND s.video_id = p.video_id)),
pairs_{r} AS (
  SELECT c.fold, c.video_id, a.video_id AS anchor_id,
    list_inner_product(p.fea, t.fea)
      / greatest(sqrt(list_inner_product(p.fea, p.fea)) * sqrt(list_inner_product(t.fea, t.fea)), 1e-8) AS sim
  FROM cand_{r} c JOIN pool p USING (video_id)
  JOIN anc_{r} a ON a.fold = c.fold JOIN train t ON t.fold = a.fold AND t.video_id = a.video_id),
sim_{r} AS (
  SELECT c.fold, c.video_id,
    greatest(-1.0, coalesce(max(CASE WHEN isnan(x.sim) THEN NULL ELSE x.sim END), -1.0)) AS similarity
  FROM cand_{r} c LEFT JOIN pairs_{r} x USING (fold, video_id) GROUP BY c.fold, c.video_id),
sel_{r} AS (
  SELECT fold, video_id, similarity, rn FROM (
    SELECT fold, video_id, similarity,
      row_number() OVER (PARTITION BY fold ORDER BY similarity DESC, video_id) AS rn
    FROM sim_{r}) WHERE rn <= (SELECT k FROM kpar))"""


def round_sql(r: int) -> str:
    """CTEs of round ``r``: reads model_r, state_r; defines sel_r, dec_r,
    model_{r+1}, state_{r+1}."""
    n = r + 1
    return _score(f"val_{r}", f"model_{r}") + selection_sql(r) + f""",
newmodel_{r} AS (
  SELECT fold, y, d, sum(s) AS s, sum(c) AS c FROM (
    SELECT fold, y, d, s, c FROM model_{r}
    UNION ALL
    SELECT s.fold, p.y, p.d, sum(p.v) AS s, count(*) AS c
    FROM sel_{r} s JOIN pool_dims p USING (video_id) GROUP BY s.fold, p.y, p.d)
  GROUP BY fold, y, d)""" + _score(f"nval_{r}", f"newmodel_{r}") + _score_test(f"tst_{r}", f"model_{r}") \
        + _score_test(f"ntst_{r}", f"newmodel_{r}") + f""",
dec_{r} AS (
  SELECT r.run AS fold, {r} AS iteration, c.f1 AS cur_f1, nv.f1 AS new_f1,
    (SELECT f1 FROM tst_{r}_f1 x WHERE x.fold = r.run) AS cur_test_f1,
    (SELECT f1 FROM ntst_{r}_f1 x WHERE x.fold = r.run) AS new_test_f1,
    coalesce((SELECT count(*) FROM cand_{r} x WHERE x.fold = r.run), 0) AS n_candidates,
    coalesce((SELECT count(*) FROM sel_{r} x WHERE x.fold = r.run), 0) AS n_selected,
    coalesce((SELECT count(*) FROM cand_{r} x WHERE x.fold = r.run), 0) > 0 AND nv.f1 > c.f1 AS accepted
  FROM runs r LEFT JOIN val_{r}_f1 c ON c.fold = r.run LEFT JOIN nval_{r}_f1 nv ON nv.fold = r.run),
model_{n} AS (
  SELECT m.* FROM newmodel_{r} m JOIN dec_{r} d ON d.fold = m.fold AND d.accepted
  UNION ALL
  SELECT m.* FROM model_{r} m JOIN dec_{r} d ON d.fold = m.fold AND NOT d.accepted),
drop_{r} AS (
  SELECT fold, video_id FROM (
    SELECT s.fold, s.video_id,
      row_number() OVER (PARTITION BY s.fold
                         ORDER BY md5('{SEED}:' || s.fold || ':' || {r} || ':' || s.video_id), s.video_id) AS rn,
      count(*) OVER (PARTITION BY s.fold) AS nf
    FROM sel_{r} s JOIN dec_{r} d ON d.fold = s.fold AND NOT d.accepted)
  WHERE rn <= nf // 2),
state_{n} AS (
  SELECT s.* FROM state_{r} s JOIN dec_{r} d ON d.fold = s.fold
  WHERE NOT d.accepted OR s.status = 'useful'
  UNION ALL
  SELECT s.fold, s.video_id, 'useful', {r} FROM sel_{r} s JOIN dec_{r} d ON d.fold = s.fold AND d.accepted
  UNION ALL
  SELECT fold, video_id, 'useless', {r} FROM drop_{r})"""


def loop_sql(rounds: int) -> str:
    """All CTEs up to state_{rounds} / model_{rounds}, without a final SELECT."""
    return "WITH " + BASE.strip() + "".join(round_sql(r) for r in range(rounds))


def softmax_sql(name: str, start: str, tset: str, epochs: int, lr: float, clip: float) -> str:
    """CTEs of ``epochs`` full-batch softmax epochs of every fold. ``start``
    (fold, d, w0, w1) are the first weights, ``tset`` (fold, rid, y) the
    training rows; xdims (rid, d, v) holds the vectors with d = 0 for the bias.
    Defines {name}_best(fold, epoch, f1) and {name}_w(fold, d, w0, w1)."""
    out, w = "", start
    for e in range(1, epochs + 1):
        out += f""",
{name}_z{e} AS MATERIALIZED (
  SELECT t.fold, t.rid, t.y, 1.0 / (1.0 + exp(-sum(x.v * (w.w1 - w.w0)))) AS p1
  FROM {tset} t JOIN xdims x USING (rid) JOIN {w} w ON w.fold = t.fold AND w.d = x.d GROUP BY t.fold, t.rid, t.y),
{name}_g{e} AS MATERIALIZED (
  SELECT z.fold, x.d, avg((z.p1 - z.y) * x.v) AS g FROM {name}_z{e} z JOIN xdims x USING (rid) GROUP BY z.fold, x.d),
{name}_s{e} AS (SELECT fold, least(1.0, {clip} / (sqrt(2 * sum(g * g)) + 1e-6)) AS s FROM {name}_g{e} GROUP BY fold),
{name}_w{e} AS MATERIALIZED (
  SELECT w.fold, w.d, w.w0 + {lr} * s.s * g.g AS w0, w.w1 - {lr} * s.s * g.g AS w1
  FROM {w} w JOIN {name}_g{e} g ON g.fold = w.fold AND g.d = w.d JOIN {name}_s{e} s ON s.fold = w.fold),
{name}_f{e} AS (
  SELECT fold, {e} AS epoch, {f1_expr('y', 'pred')} AS f1 FROM (
    SELECT t.fold, t.rid, t.y, CASE WHEN sum(x.v * (w.w1 - w.w0)) > 0 THEN 1 ELSE 0 END AS pred
    FROM vset t JOIN xdims x USING (rid) JOIN {name}_w{e} w ON w.fold = t.fold AND w.d = x.d GROUP BY t.fold, t.rid, t.y)
  GROUP BY fold)"""
        w = f"{name}_w{e}"
    every = " UNION ALL ".join(f"SELECT * FROM {name}_f{e}" for e in range(1, epochs + 1))
    weights = " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM {name}_w{e}" for e in range(1, epochs + 1))
    return out + f""",
{name}_best AS (
  SELECT fold, epoch, f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, epoch) AS rn FROM ({every}))
  WHERE rn = 1),
{name}_w AS MATERIALIZED (SELECT w.fold, w.d, w.w0, w.w1 FROM ({weights}) w JOIN {name}_best b USING (fold, epoch))"""


def iterative_round_sql(epochs: int, lr: float, clip: float) -> str:
    """A first round under the softmax head: fit on the training folds, select,
    fit again from there with the selection."""
    score = """
SELECT fold, video_id, y, l0, l1, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred,
  exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p0,
  exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p1
FROM (SELECT t.fold, t.rid AS video_id, t.y, sum(x.v * w.w0) AS l0, sum(x.v * w.w1) AS l1
      FROM vset t JOIN xdims x USING (rid) JOIN first_w w ON w.fold = t.fold AND w.d = x.d GROUP BY t.fold, t.rid, t.y)"""
    return "WITH " + BASE.strip() + """,
vset AS (SELECT fold, video_id AS rid, y FROM train),
xdims AS MATERIALIZED (
  SELECT video_id AS rid, unnest(generate_series(0, len(fea))) AS d, unnest(list_prepend(1.0, fea)) AS v FROM items),
zero_w AS (SELECT r.run AS fold, d, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM runs r, (SELECT DISTINCT d FROM xdims)),
tset_0 AS (SELECT r.run AS fold, t.video_id AS rid, t.y FROM train t JOIN runs r ON t.fold <> r.run)""" \
        + softmax_sql("first", "zero_w", "tset_0", epochs, lr, clip) + f""",
val_0 AS ({score})""" + selection_sql(0) + """,
tset_1 AS (SELECT * FROM tset_0 UNION ALL SELECT s.fold, s.video_id, p.y FROM sel_0 s JOIN pool p USING (video_id))""" \
        + softmax_sql("second", "first_w", "tset_1", epochs, lr, clip)
