"""Registry of the checkable queries: a Spark callable ``(spark, sf_dir) ->
DataFrame`` and, where the operator is SQL-expressible, the DuckDB text of the
same result. Output types are normalised on both sides: integers BIGINT,
floats DOUBLE rounded to 6 decimals, booleans 0/1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import audio_key, fabrication_fields, motion_key
from ..operators import features as feat
from ..operators import folds as fo
from ..operators import gate
from ..operators import metrics as me
from ..operators import pool as po
from ..operators import sequences as sq
from ..operators import stats as st
from ..operators import training as tr
from ..operators import transitions as ts
from ..operators.ranking import rank_within
from ..session import read_table, scratch_path
from ..sources import io, store
from . import active_learning as al
from . import fixtures as fx
from .oracle_al import BASE as AL_BASE, f1_expr, iterative_round_sql, loop_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries that SQL can't express, each with tests of its own.
ROWS_ONLY = {"quality_gate_learned"}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Normalise output types (see module doc)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_out(body: str, cols: list[tuple[str, str]], ctes: str = "") -> str:
    """Wrap ``body`` with the same normalisation: kinds i(nt), d(ouble),
    s(tring), b(ool)."""
    sel = []
    for name, kind in cols:
        if kind == "i":
            sel.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "d":
            sel.append(f"round(CAST({name} AS DOUBLE), 6) AS {name}")
        elif kind == "b":
            sel.append(f"CAST(CAST({name} AS INTEGER) AS BIGINT) AS {name}")
        else:
            sel.append(f"CAST({name} AS VARCHAR) AS {name}")
    inner = f"{ctes}\n{body}" if ctes else body
    return f"SELECT {', '.join(sel)} FROM (\n{inner}\n) q"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes)


# ---------------------------------------------------------------------------
# shared Spark inputs

def _items(spark, sf):
    return fx.fx_items(spark, sf).withColumn("y", F.when(F.col("label") == "real", 0).otherwise(1))


def _al_data(spark, sf, cfg: al.ALConfig | None = None) -> tuple[al.ALData, al.ALConfig]:
    cfg = cfg or al.ALConfig()
    items = fx.fx_items(spark, sf)
    train_ids = items.filter(F.col("split") == "train").select("video_id")
    test_ids = items.filter(F.col("split") == "test").select("video_id")
    return al.prepare(items, train_ids, test_ids, fx.fx_seed_ids(spark, sf), cfg), cfg


def _round0(spark, sf):
    data, cfg = _al_data(spark, sf)
    rnd = al.al_round(data, al.begin(data, cfg), 0, cfg)
    return data, cfg, rnd


# ---------------------------------------------------------------------------
# A. sources and sinks

@query("manifest_scan", sql_out(
    "SELECT video_id, title, ocr, len(visual_materials) AS n_materials, "
    "array_to_string(visual_materials, '|') AS materials, label, source FROM fx_manifest",
    [("video_id", "s"), ("title", "s"), ("ocr", "s"), ("n_materials", "i"), ("materials", "s"),
     ("label", "s"), ("source", "s")], _with(fx.FX_MANIFEST_SQL)))
def q_manifest_scan(spark, sf):
    path = scratch_path(spark, "manifest")
    fx.fx_manifest(spark, sf).write.mode("overwrite").json(path)
    m = io.read_manifest(spark, path)
    return finish(m.select("video_id", "title", "ocr", F.size("visual_materials").alias("n_materials"),
                           F.array_join("visual_materials", "|").alias("materials"), "label", "source"))


@query("manifest_quarantine", sql_out(
    "SELECT 'good' AS kind, video_id AS line FROM fx_manifest UNION ALL "
    "SELECT 'bad', concat('{\"video_id\": \"', video_id, '\", \"title\": ') FROM fx_items WHERE vec_id % 9 = 4 UNION ALL "
    "SELECT 'bad', concat('{\"title\": \"', video_id, '\"}') FROM fx_items WHERE vec_id % 9 = 7",
    [("kind", "s"), ("line", "s")], _with(fx.FX_MANIFEST_SQL)))
def q_manifest_quarantine(spark, sf):
    """Cut-off lines and lines without an id never become items."""
    it = fx.fx_items(spark, sf)
    v = F.col("vec_id")
    cut = it.filter(v % 9 == 4).select(F.concat(F.lit('{"video_id": "'), "video_id", F.lit('", "title": ')).alias("value"))
    anon = it.filter(v % 9 == 7).select(F.concat(F.lit('{"title": "'), "video_id", F.lit('"}')).alias("value"))
    m = fx.fx_manifest(spark, sf)
    path = scratch_path(spark, "manifest")
    m.select(F.to_json(F.struct(*m.columns)).alias("value")).unionByName(cut).unionByName(anon).write.text(path)
    good = io.read_manifest(spark, path, on_bad="quarantine").select(F.lit("good").alias("kind"), F.col("video_id").alias("line"))
    bad = io.parse_manifest(spark, path).filter("_bad IS NOT NULL").select(F.lit("bad").alias("kind"), F.col("_bad").alias("line"))
    return finish(good.unionByName(bad))


@query("id_list_scan", sql_out(
    "SELECT video_id FROM fx_items UNION ALL SELECT '' AS video_id FROM fx_items WHERE vec_id % 50 = 7",
    [("video_id", "s")], _with(fx.FX_ITEMS_SQL)))
def q_id_list_scan(spark, sf):
    it = fx.fx_items(spark, sf)
    v = F.col("vec_id")
    pad = (F.when(v % 6 == 1, F.concat(F.lit(" "), "video_id", F.lit("\t")))
           .when(v % 6 == 2, F.concat(F.lit("\t"), "video_id", F.lit("  ")))
           .when(v % 6 == 3, F.concat("video_id", F.lit("\r")))
           .when(v % 6 == 4, F.concat(F.lit("\u3000"), "video_id", F.lit("\u00a0")))
           .when(v % 6 == 5, F.concat(F.lit("\x1c\u2003"), "video_id", F.lit("\x85")))
           .otherwise(F.col("video_id")))
    lines = it.select(pad.alias("video_id")).unionByName(
        it.filter(v % 50 == 7).select(F.lit("   ").alias("video_id")))
    path = scratch_path(spark, "ids")
    io.write_id_list(lines, path)
    return finish(io.read_id_list(spark, path))


@query("selected_ids_sink", sql_out(
    "SELECT fold, 0 AS iteration, video_id FROM folds",
    [("fold", "i"), ("iteration", "i"), ("video_id", "s")], _with(AL_BASE)))
def q_selected_ids_sink(spark, sf):
    it = fx.fx_items(spark, sf).filter(F.col("split") == "train").select("video_id")
    folds = fo.kfold(it, 5, 2025).withColumn("iteration", F.lit(0))
    path = scratch_path(spark, "selected")
    io.append_ids(folds, path)
    io.append_ids(folds, path)  # a re-run of the same round must not duplicate rows
    return finish(io.read_version(spark, path).select("fold", "iteration", "video_id"))


@query("versioned_ids_sink", sql_out(
    "SELECT 'first' AS state, 0 AS version, fold, 0 AS iteration, video_id FROM folds UNION ALL "
    "SELECT 'after a lost write', 0, fold, 0, video_id FROM folds UNION ALL "
    "SELECT 'last', 2, fold, 0, video_id FROM folds WHERE fold <> 2 UNION ALL "
    "SELECT 'last', 2, fold, 0, video_id FROM folds WHERE fold = 2 AND video_id LIKE '%1' UNION ALL "
    "SELECT 'last', 2, fold, 1, video_id FROM folds WHERE fold = 1",
    [("state", "s"), ("version", "i"), ("fold", "i"), ("iteration", "i"), ("video_id", "s")], _with(AL_BASE)))
def q_versioned_ids_sink(spark, sf):
    """A sink through its versions: all folds written; a write that dies half
    way, which readers never see; a new round of fold 1; fold 2 replaced."""
    it = fx.fx_items(spark, sf).filter(F.col("split") == "train").select("video_id")
    folds = fo.kfold(it, 5, 2025).withColumn("iteration", F.lit(0))
    path = scratch_path(spark, "versions")
    io.append_ids(folds, path)
    seen = [io.read_version(spark, path).withColumn("state", F.lit("first")).withColumn("version", F.lit(0))]
    dies = F.when(F.crc32("video_id") % 2 == 0, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("video_id"))
    try:
        io.append_ids(folds.withColumn("video_id", dies), path)
    except Exception as lost:  # what the query is about
        if "lost" not in str(lost):
            raise
    number = io.version_record(spark, path)["version"]
    seen.append(io.read_version(spark, path).withColumn("state", F.lit("after a lost write")).withColumn("version", F.lit(number)))
    io.append_ids(folds.filter("fold = 1").withColumn("iteration", F.lit(1)), path)
    io.append_ids(folds.filter((F.col("fold") == 2) & F.col("video_id").endswith("1")), path)
    number = io.version_record(spark, path)["version"]
    seen.append(io.read_version(spark, path).withColumn("state", F.lit("last")).withColumn("version", F.lit(number)))
    return finish(seen[0].unionByName(seen[1]).unionByName(seen[2]).select("state", "version", "fold", "iteration", "video_id"))


@query("centroid_fit", sql_out(
    "SELECT fold, y, d - 1 AS d, c AS n, s / c AS value FROM model_0",
    [("fold", "i"), ("y", "i"), ("d", "i"), ("n", "i"), ("value", "d")], _with(AL_BASE)))
def q_centroid_fit(spark, sf):
    data, _ = _al_data(spark, sf)
    model = tr.centroids_from_sums(data.init_sums, ["fold"])
    path = scratch_path(spark, "model")
    io.save_model(model, path)
    m = io.load_model(spark, path)
    return finish(m.select("fold", "y", F.posexplode("centroid").alias("d", "value"), "n")
                  .select("fold", "y", "d", "n", "value"))


# ---------------------------------------------------------------------------
# B. projections, filters, predicates

@query("generated_pool", sql_out("SELECT video_id FROM pool", [("video_id", "s")], _with(AL_BASE)))
def q_generated_pool(spark, sf):
    return finish(po.generated_pool(fx.fx_items(spark, sf), fx.fx_seed_ids(spark, sf)).select("video_id"))


@query("manifest_restrict", sql_out(
    "SELECT video_id, label, source FROM fx_manifest WHERE video_id IN "
    "(SELECT video_id FROM fx_items WHERE split = 'val' UNION ALL SELECT video_id FROM fx_items WHERE split = 'val')",
    [("video_id", "s"), ("label", "s"), ("source", "s")], _with(fx.FX_MANIFEST_SQL)))
def q_manifest_restrict(spark, sf):
    it = fx.fx_items(spark, sf)
    ids = it.filter(F.col("split") == "val").select("video_id")
    ids = ids.unionByName(ids)  # duplicates in the id list do not multiply rows
    return finish(po.restrict(fx.fx_manifest(spark, sf), ids).select("video_id", "label", "source"))


@query("label_encode", sql_out(
    "SELECT video_id, label, CASE WHEN label IS NOT DISTINCT FROM 'real' THEN 0 ELSE 1 END AS y FROM fx_manifest",
    [("video_id", "s"), ("label", "s"), ("y", "i")], _with(fx.FX_MANIFEST_SQL)))
def q_label_encode(spark, sf):
    return finish(po.encode_label(fx.fx_manifest(spark, sf), "fakett").select("video_id", "label", "y"))


@query("candidate_pool", sql_out(
    "SELECT r.run AS fold, p.video_id FROM pool p CROSS JOIN runs r "
    "WHERE NOT EXISTS (SELECT 1 FROM state_1 s WHERE s.fold = r.run AND s.video_id = p.video_id)",
    [("fold", "i"), ("video_id", "s")], loop_sql(1)))
def q_candidate_pool(spark, sf):
    data, cfg, rnd = _round0(spark, sf)
    state = al.apply_decision(rnd, cfg).state
    pool = data.pool.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(cfg.k_folds - 1))))
    return finish(po.candidates(pool, state).select("fold", "video_id"))


# fixed values: codes, states and type names of functions/ids.py
_FAB_SQL = """
SELECT video_id, seed_id, fabrication_code,
  CASE WHEN ok THEN CASE substr(fabrication_code, 2, 1) WHEN 'O' THEN 'original' WHEN 'M' THEN 'manipulated' WHEN 'N' THEN 'null' END END AS in_text,
  CASE WHEN ok THEN CASE substr(fabrication_code, 4, 1) WHEN 'O' THEN 'original' WHEN 'M' THEN 'manipulated' WHEN 'N' THEN 'null' END END AS in_visual,
  CASE WHEN ok THEN CASE substr(fabrication_code, 7, 1) WHEN 'O' THEN 'original' WHEN 'M' THEN 'manipulated' WHEN 'N' THEN 'null' END END AS out_text,
  CASE WHEN ok THEN CASE substr(fabrication_code, 9, 1) WHEN 'O' THEN 'original' WHEN 'M' THEN 'manipulated' WHEN 'N' THEN 'null' END END AS out_visual,
  CASE fabrication_code WHEN 'TOVN_TOVM' THEN 'Misleading Substitution' WHEN 'TNVO_TMVO' THEN 'Groundless Fabrication'
    WHEN 'TOVO_TMVO' THEN 'Fact Distortion' WHEN 'TOVO_TOVM' THEN 'Selective Editing'
    ELSE CASE WHEN ok THEN 'other' END END AS fabrication_type
FROM (
  SELECT video_id, split_part(video_id, '_', 1) AS seed_id, fabrication_code,
    coalesce(regexp_full_match(fabrication_code, 'T[OMN]V[OMN]_T[OMN]V[OMN]'), false) AS ok
  FROM (SELECT video_id, CASE WHEN strpos(video_id, '_') > 0 THEN substr(video_id, strpos(video_id, '_') + 1) END
               AS fabrication_code FROM fx_items))"""


@query("fabrication_parse", sql_out(
    _FAB_SQL.strip(), [("video_id", "s"), ("seed_id", "s"), ("fabrication_code", "s"), ("in_text", "s"),
                       ("in_visual", "s"), ("out_text", "s"), ("out_visual", "s"), ("fabrication_type", "s")],
    _with(fx.FX_ITEMS_SQL)))
def q_fabrication_parse(spark, sf):
    f = fabrication_fields("video_id")
    return finish(fx.fx_items(spark, sf).select("video_id", *[c.alias(n) for n, c in f.items()]))


@query("clip_parse", sql_out(
    "SELECT item_id, material_pos, split_part(clip, '_', 1) AS src, "
    "TRY_CAST(substr(split_part(clip, '_', 2), 2) AS INTEGER) AS s, "
    "TRY_CAST(substr(split_part(clip, '_', 3), 2) AS INTEGER) AS e FROM fx_clips",
    [("item_id", "i"), ("material_pos", "i"), ("src", "s"), ("s", "i"), ("e", "i")], _with(fx.FX_CLIPS_SQL)))
def q_clip_parse(spark, sf):
    p = sq.parse_clips(fx.fx_clips(spark, sf))
    return finish(p.select("item_id", "material_pos", "src", "s", "e"))


@query("feature_keys", sql_out(
    "SELECT video_id, split_part(visual_materials[1], '_', 1) AS audio_key, "
    "CASE WHEN contains(video_id, 'TMVO') THEN split_part(video_id, '_', 1) ELSE video_id END AS motion_key "
    "FROM fx_manifest",
    [("video_id", "s"), ("audio_key", "s"), ("motion_key", "s")], _with(fx.FX_MANIFEST_SQL)))
def q_feature_keys(spark, sf):
    m = fx.fx_manifest(spark, sf)
    return finish(m.select("video_id", audio_key("visual_materials").alias("audio_key"),
                           motion_key("video_id").alias("motion_key")))


# ---------------------------------------------------------------------------
# C. joins over sequences and features

_LEN_SQL = """
lens AS (
  SELECT c.item_id, c.material_pos, c.src, c.s, c.e, coalesce(n.n, 0) AS n,
    greatest(0, least(coalesce(n.n, 0), c.e + 1) - least(coalesce(n.n, 0), c.s)) AS len
  FROM (SELECT item_id, material_pos, split_part(clip, '_', 1) AS src,
          TRY_CAST(substr(split_part(clip, '_', 2), 2) AS INTEGER) AS s,
          TRY_CAST(substr(split_part(clip, '_', 3), 2) AS INTEGER) AS e FROM fx_clips) c
  LEFT JOIN (SELECT key, count(*) AS n FROM fx_seq GROUP BY key) n ON n.key = c.src),
offs AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY item_id ORDER BY material_pos
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clip_offset
  FROM lens)"""


@query("clip_lengths", sql_out(
    "SELECT item_id, material_pos, src, s, e, n, len, clip_offset FROM offs",
    [("item_id", "i"), ("material_pos", "i"), ("src", "s"), ("s", "i"), ("e", "i"), ("n", "i"),
     ("len", "i"), ("clip_offset", "i")], _with(fx.FX_CLIPS_SQL, fx.FX_SEQ_SQL, _LEN_SQL)))
def q_clip_lengths(spark, sf):
    cl = sq.clip_lengths(fx.fx_clips(spark, sf), fx.fx_seq(spark, sf))
    return finish(cl.select("item_id", "material_pos", "src", "s", "e", "n", "len", "clip_offset"))


_BAD_CLIP_SQL = """
bclips AS (
  SELECT item_id, material_pos,
    CASE WHEN item_id % 11 = 3 AND material_pos = 2 THEN concat(split_part(clip, '_', 1), '_Sx_E9')
         WHEN item_id % 13 = 5 AND material_pos = 1 THEN concat('none', clip) ELSE clip END AS clip
  FROM fx_clips),
bad AS (SELECT DISTINCT item_id FROM bclips WHERE item_id % 11 = 3 AND material_pos = 2 OR item_id % 13 = 5)"""


@query("clip_quarantine", sql_out(
    "SELECT item_id, material_pos, src, s, e, n, len, clip_offset FROM offs WHERE item_id NOT IN (SELECT item_id FROM bad)",
    [("item_id", "i"), ("material_pos", "i"), ("src", "s"), ("s", "i"), ("e", "i"), ("n", "i"),
     ("len", "i"), ("clip_offset", "i")], _with(fx.FX_CLIPS_SQL, fx.FX_SEQ_SQL, _LEN_SQL, _BAD_CLIP_SQL)))
def q_clip_quarantine(spark, sf):
    """A malformed clip or a source without frames takes its whole item out."""
    c = fx.fx_clips(spark, sf)
    item, at = F.col("item_id"), F.col("material_pos")
    clip = (F.when((item % 11 == 3) & (at == 2), F.concat(F.split_part("clip", F.lit("_"), F.lit(1)), F.lit("_Sx_E9")))
            .when((item % 13 == 5) & (at == 1), F.concat(F.lit("none"), "clip")).otherwise(F.col("clip")))
    cl = sq.clip_lengths(c.withColumn("clip", clip), fx.fx_seq(spark, sf), on_bad="quarantine")
    return finish(cl.select("item_id", "material_pos", "src", "s", "e", "n", "len", "clip_offset"))


@query("clip_frames", sql_out(
    "SELECT o.item_id, o.clip_offset + f.pos - o.s AS pos, f.x FROM offs o "
    "JOIN fx_seq f ON f.key = o.src AND f.pos BETWEEN o.s AND o.e",
    [("item_id", "i"), ("pos", "i"), ("x", "d")], _with(fx.FX_CLIPS_SQL, fx.FX_SEQ_SQL, _LEN_SQL)))
def q_clip_frames(spark, sf):
    return finish(sq.clip_frames(fx.fx_clips(spark, sf), fx.fx_seq(spark, sf)).select("item_id", "pos", "x"))


def _stores(spark, sf, text_all: bool = True) -> dict[str, DataFrame]:
    seq = fx.fx_seq(spark, sf)
    it = fx.fx_items(spark, sf)
    u = fx.n_users(spark, sf)
    t_items = it if text_all else it.filter(F.col("vec_id") % 3 != 2)
    text = (t_items.select("video_id", (F.col("vec_id") % u).cast("string").alias("_u"))
            .join(seq, F.col("_u") == F.col("key")).select(F.col("video_id").alias("key"), "pos", "x"))
    motion = (it.filter(~F.col("video_id").contains("TMVO"))
              .select("video_id", ((F.col("vec_id") * 7) % u).cast("string").alias("_u"))
              .join(seq, F.col("_u") == F.col("key")).select(F.col("video_id").alias("key"), "pos", "x"))
    return {"text": text, "audio": seq, "frames": seq, "motion": motion}


_STORES_SQL = """
text_store AS (
  SELECT i.video_id AS key, s.pos, s.x FROM fx_items i JOIN fx_seq s ON s.key = CAST(i.vec_id % (SELECT count(DISTINCT user_id) FROM events) AS VARCHAR)),
human_text_store AS (
  SELECT i.video_id AS key, s.pos, s.x FROM fx_items i JOIN fx_seq s ON s.key = CAST(i.vec_id % (SELECT count(DISTINCT user_id) FROM events) AS VARCHAR)
  WHERE i.vec_id % 3 <> 2),
motion_store AS (
  SELECT i.video_id AS key, s.pos, s.x FROM fx_items i JOIN fx_seq s ON s.key = CAST((i.vec_id * 7) % (SELECT count(DISTINCT user_id) FROM events) AS VARCHAR)
  WHERE NOT contains(i.video_id, 'TMVO'))"""


def _fixed_sql(name: str, src: str, L: int, lengths: str | None = None) -> str:
    """Stride-sample / pad / mask of ``src(key, pos, x)`` to ``L`` rows."""
    lengths = lengths or f"(SELECT key, count(*) AS n FROM {src} GROUP BY key)"
    return f"""
{name}_n AS {lengths},
{name} AS (
  SELECT s.key, CAST(s.pos // greatest(n.n // {L}, 1) AS INTEGER) AS pos, s.x, 1 AS mask
  FROM {src} s JOIN {name}_n n USING (key)
  WHERE s.pos % greatest(n.n // {L}, 1) = 0 AND s.pos // greatest(n.n // {L}, 1) < {L}
  UNION ALL
  SELECT key, CAST(unnest(generate_series(n, {L} - 1)) AS INTEGER) AS pos, 0.0 AS x, 0 AS mask
  FROM {name}_n WHERE n < {L})"""


_ASSEMBLE_SQL = """
keys AS (
  SELECT video_id, split_part(visual_materials[1], '_', 1) AS audio_key,
    CASE WHEN contains(video_id, 'TMVO') THEN split_part(video_id, '_', 1) ELSE video_id END AS motion_key,
    visual_materials
  FROM fx_manifest),
audio_raw AS (SELECT k.video_id AS key, s.pos, s.x FROM keys k JOIN fx_seq s ON s.key = k.audio_key),
motion_raw AS (SELECT k.video_id AS key, s.pos, s.x FROM keys k JOIN motion_store s ON s.key = k.motion_key),
mclips AS (
  SELECT video_id AS item_id, CAST(unnest(generate_series(0, len(visual_materials) - 1)) AS INTEGER) AS material_pos,
    unnest(visual_materials) AS clip FROM keys),
mlens AS (
  SELECT c.item_id, c.material_pos, c.src, c.s, c.e,
    greatest(0, least(coalesce(n.n, 0), c.e + 1) - least(coalesce(n.n, 0), c.s)) AS len
  FROM (SELECT item_id, material_pos, split_part(clip, '_', 1) AS src,
          TRY_CAST(substr(split_part(clip, '_', 2), 2) AS INTEGER) AS s,
          TRY_CAST(substr(split_part(clip, '_', 3), 2) AS INTEGER) AS e FROM mclips) c
  LEFT JOIN (SELECT key, count(*) AS n FROM fx_seq GROUP BY key) n ON n.key = c.src),
mparsed AS (
  SELECT item_id, clip, split_part(clip, '_', 1) AS src,
    coalesce(TRY_CAST(substr(split_part(clip, '_', 2), 2) AS INTEGER) >= 0
             AND TRY_CAST(substr(split_part(clip, '_', 3), 2) AS INTEGER) >= 0
             AND length(split_part(clip, '_', 1)) > 0, false) AS ok
  FROM mclips),
moffs AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY item_id ORDER BY material_pos
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clip_offset
  FROM mlens WHERE len > 0),
frames_raw AS (
  SELECT o.item_id AS key, CAST(o.clip_offset + f.pos - o.s AS INTEGER) AS pos, f.x
  FROM moffs o JOIN fx_seq f ON f.key = o.src AND f.pos BETWEEN o.s AND o.e),""" + \
    _fixed_sql("audio_fx", "audio_raw", 50) + "," + _fixed_sql("motion_fx", "motion_raw", 83) + "," + \
    _fixed_sql("frames_fx", "frames_raw", 83, "(SELECT item_id AS key, CAST(sum(len) AS BIGINT) AS n FROM mlens GROUP BY item_id)")


@query("feature_assemble", sql_out(
    "SELECT k.video_id, 'text' AS modality, t.pos, t.x, 1 AS mask FROM keys k JOIN text_store t ON t.key = k.video_id "
    "UNION ALL SELECT key, 'audio', pos, x, mask FROM audio_fx "
    "UNION ALL SELECT key, 'frames', pos, x, mask FROM frames_fx "
    "UNION ALL SELECT key, 'motion', pos, x, mask FROM motion_fx",
    [("video_id", "s"), ("modality", "s"), ("pos", "i"), ("x", "d"), ("mask", "i")],
    _with(fx.FX_MANIFEST_SQL, fx.FX_SEQ_SQL, _STORES_SQL, _ASSEMBLE_SQL)))
def q_feature_assemble(spark, sf):
    """Lengths first, then only the kept frame rows are fetched."""
    out = feat.feature_assemble(fx.fx_manifest(spark, sf), _stores(spark, sf), ["x"])
    return finish(out.select("video_id", "modality", "pos", "x", "mask"))


@query("bucketed_assemble", ORACLES["feature_assemble"])
def q_bucketed_assemble(spark, sf):
    """The assembly from stores written as bucketed tables: positions are sent
    to the vectors' buckets, the vectors stay."""
    stores, made = {}, {}
    for name, df in _stores(spark, sf).items():
        if name == "frames":  # the same rows as audio
            continue
        at = scratch_path(spark, f"store-{name}")
        made[name] = store.write_store(df, "poolwise_" + at.rsplit("/", 1)[1].replace("-", "_"), at)
    stores = {**made, "frames": made["audio"]}
    out = feat.feature_assemble(fx.fx_manifest(spark, sf), stores, ["x"])
    return finish(out.select("video_id", "modality", "pos", "x", "mask"))


@query("assemble_two_modalities", sql_out(
    "SELECT p.key AS video_id, 'cover' AS modality, p.pos, p.x, p.mask FROM cover_fx p "
    "UNION ALL SELECT k.video_id, 'opening', s.pos, s.x, 1 FROM keys k JOIN fx_seq s ON s.key = k.audio_key AND s.pos < 12 "
    "UNION ALL SELECT k.video_id, 'opening', CAST(unnest(generate_series(n.n, 11)) AS INTEGER), 0.0, 0 FROM keys k "
    "JOIN (SELECT key, count(*) AS n FROM fx_seq GROUP BY key) n ON n.key = k.audio_key WHERE n.n < 12",
    [("video_id", "s"), ("modality", "s"), ("pos", "i"), ("x", "d"), ("mask", "i")],
    _with(fx.FX_MANIFEST_SQL, fx.FX_SEQ_SQL, _STORES_SQL, _ASSEMBLE_SQL) + """,
cover_raw AS (SELECT k.video_id AS key, t.pos, t.x FROM keys k JOIN motion_store t ON t.key = split_part(k.video_id, '_', 1)),""" +
    _fixed_sql("cover_fx", "cover_raw", 7)))
def q_assemble_two_modalities(spark, sf):
    """Another declaration than the published four: 7 rows sampled from the
    seed item's motion, and the first 12 rows of the first material's audio."""
    from ..functions.ids import seed_id
    specs = (feat.Modality("cover", "motion", lambda: seed_id("video_id"), "stride", 7),
             feat.Modality("opening", "sound", lambda: audio_key("visual_materials"), "head", 12))
    s = _stores(spark, sf)
    items, stores = fx.fx_manifest(spark, sf), {"motion": s["motion"], "sound": s["audio"]}
    out = feat.feature_assemble(items, stores, ["x"], modalities=specs, on_missing="quarantine")
    return finish(out.select("video_id", "modality", "pos", "x", "mask"))


@query("missing_features", sql_out(
    "SELECT k.video_id, 'text' AS modality, k.video_id AS missing_key FROM keys k "
    "WHERE k.video_id NOT IN (SELECT key FROM human_text_store) "
    "UNION ALL SELECT k.video_id, 'audio', k.audio_key FROM keys k WHERE k.audio_key NOT IN (SELECT key FROM fx_seq) "
    "UNION ALL SELECT k.video_id, 'motion', k.motion_key FROM keys k "
    "WHERE k.motion_key NOT IN (SELECT key FROM motion_store) "
    "UNION ALL SELECT DISTINCT item_id, 'frames', src FROM mparsed WHERE ok AND src NOT IN (SELECT key FROM fx_seq) "
    "UNION ALL SELECT item_id, 'clip', clip FROM mparsed WHERE NOT ok "
    "UNION ALL SELECT video_id, 'clip', '' FROM keys WHERE coalesce(len(visual_materials), 0) = 0",
    [("video_id", "s"), ("modality", "s"), ("missing_key", "s")],
    _with(fx.FX_MANIFEST_SQL, fx.FX_SEQ_SQL, _STORES_SQL, _ASSEMBLE_SQL)))
def q_missing_features(spark, sf):
    stores = _stores(spark, sf, text_all=False)
    return finish(feat.missing_features(fx.fx_manifest(spark, sf), stores))


# ---------------------------------------------------------------------------
# E. sequences: sampling and padding

@query("stride_sample", sql_out(
    "SELECT s.key, s.pos // greatest(n.n // 16, 1) AS pos, s.x, n.n FROM fx_seq s "
    "JOIN (SELECT key, count(*) AS n FROM fx_seq GROUP BY key) n USING (key) "
    "WHERE s.pos % greatest(n.n // 16, 1) = 0 AND s.pos // greatest(n.n // 16, 1) < 16",
    [("key", "s"), ("pos", "i"), ("x", "d"), ("n", "i")], _with(fx.FX_SEQ_SQL)))
def q_stride_sample(spark, sf):
    return finish(sq.stride_sample(fx.fx_seq(spark, sf), 16).select("key", "pos", "x", "n"))


@query("pad_mask", sql_out(
    "SELECT key, pos, x, mask FROM fixed83",
    [("key", "s"), ("pos", "i"), ("x", "d"), ("mask", "i")], _with(fx.FX_SEQ_SQL, _fixed_sql("fixed83", "fx_seq", 83))))
def q_pad_mask(spark, sf):
    return finish(sq.fixed_length(fx.fx_seq(spark, sf), 83, ["x"]).select("key", "pos", "x", "mask"))


@query("head_pad", sql_out(
    "SELECT key, pos, x FROM fx_seq WHERE pos < 50 UNION ALL "
    "SELECT key, unnest(generate_series(n, 49)) AS pos, 0.0 AS x FROM "
    "(SELECT key, count(*) AS n FROM fx_seq GROUP BY key) WHERE n < 50",
    [("key", "s"), ("pos", "i"), ("x", "d")], _with(fx.FX_SEQ_SQL)))
def q_head_pad(spark, sf):
    return finish(sq.head_pad(fx.fx_seq(spark, sf), 50, ["x"]))


_FAULTY_SEQ_SQL = """
fseq AS (
  SELECT key, CASE WHEN CAST(key AS BIGINT) % 7 = 2 AND pos >= 3 THEN pos + 2 ELSE pos END AS pos,
    CASE WHEN CAST(key AS BIGINT) % 11 = 4 AND pos = 1 THEN NULL WHEN CAST(key AS BIGINT) % 13 = 5 AND pos = 2 THEN [x, x, x]
         WHEN CAST(key AS BIGINT) % 17 = 6 AND pos = 0 THEN [x, 'nan'::DOUBLE] ELSE [x, -x] END AS vec FROM fx_seq
  UNION ALL SELECT key, pos, [x, x] FROM fx_seq WHERE CAST(key AS BIGINT) % 5 = 1 AND pos = 4),
stats AS (
  SELECT key, max(n) AS n, count(*) AS d, min(pos) AS lo, max(pos) AS hi, max(nul) AS nul, min(wlo) AS wlo, max(whi) AS whi, max(bad) AS bad
  FROM (SELECT key, pos, count(*) AS n, max(CASE WHEN vec IS NULL THEN 1 ELSE 0 END) AS nul, min(len(vec)) AS wlo, max(len(vec)) AS whi,
          max(CASE WHEN len(list_filter(vec, lambda v: isnan(v))) > 0 THEN 1 ELSE 0 END) AS bad FROM fseq GROUP BY key, pos) GROUP BY key),
faults AS (
  SELECT key, 'repeat' AS reason FROM stats WHERE n > 1 UNION ALL SELECT key, 'gap' FROM stats WHERE lo <> 0 OR hi <> d - 1
  UNION ALL SELECT key, 'no vector' FROM stats WHERE nul > 0 UNION ALL SELECT key, 'width' FROM stats WHERE wlo <> whi
  UNION ALL SELECT key, 'not a number' FROM stats WHERE bad > 0)"""


@query("sequence_quarantine", sql_out(
    "SELECT key, reason, CAST(NULL AS BIGINT) AS pos FROM faults UNION ALL "
    "SELECT key, 'sound', pos FROM fseq WHERE key NOT IN (SELECT key FROM faults)",
    [("key", "s"), ("reason", "s"), ("pos", "i")], _with(fx.FX_SEQ_SQL, _FAULTY_SEQ_SQL)))
def q_sequence_quarantine(spark, sf):
    """Stored sequences with gaps, repeats, missing vectors, mixed widths and
    entries that are not numbers: what is wrong with each, and the rows of
    those that can be used."""
    s = fx.fx_seq(spark, sf)
    k, p, x = F.col("key").cast("long"), F.col("pos"), F.col("x").cast("double")
    vec = (F.when((k % 11 == 4) & (p == 1), F.lit(None)).when((k % 13 == 5) & (p == 2), F.array(x, x, x))
           .when((k % 17 == 6) & (p == 0), F.array(x, F.lit(float("nan")))).otherwise(F.array(x, -x)))
    faulty = s.select("key", F.when((k % 7 == 2) & (p >= 3), p + 2).otherwise(p).alias("pos"), vec.alias("vec"))
    faulty = faulty.unionByName(s.filter((k % 5 == 1) & (p == 4)).select("key", "pos", F.array(x, x).alias("vec")))
    bad = sq.sequence_faults(faulty).withColumn("pos", F.lit(None).cast("long"))
    good = sq.sound_sequences(faulty).select("key", F.lit("sound").alias("reason"), F.col("pos").cast("long").alias("pos"))
    return finish(bad.unionByName(good))


@query("shot_segments", sql_out(
    """SELECT key, segment, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_frames,
         concat(key, '_S', CAST(min(pos) AS VARCHAR), '_E', CAST(max(pos) AS VARCHAR)) AS clip
       FROM (SELECT key, pos, sum(cut) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS segment
             FROM (SELECT key, pos, CASE WHEN prev IS NULL THEN 1
                     WHEN list_inner_product(vec, prev) / greatest(sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(prev, prev)), 1e-8) < 0.1
                     THEN 1 ELSE 0 END AS cut
                   FROM (SELECT CAST(label AS VARCHAR) AS key, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS vec,
                           lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS prev
                         FROM embeddings)))
       GROUP BY key, segment""",
    [("key", "s"), ("segment", "i"), ("start_pos", "i"), ("end_pos", "i"), ("n_frames", "i"), ("clip", "s")]))
def q_shot_segments(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("key"),
                                                  F.col("vec_id").alias("pos"),
                                                  F.col("embedding").cast("array<double>").alias("vec"))
    return finish(sq.shot_segments(e, 0.1).select("key", "segment", "start_pos", "end_pos", "n_frames", "clip"))


_TRANSITIONS_SQL = """WITH RECURSIVE frames AS (
    SELECT CAST(label AS VARCHAR) AS key, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS vec,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n,
      lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS prev
    FROM embeddings),
  steps AS (
    SELECT key, pos, rn, n, CASE WHEN rn = 1 THEN 0 ELSE CAST(round((1 - list_inner_product(vec, prev)
      / greatest(sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(prev, prev)), 1e-8)) * 1000000) AS BIGINT) END AS q
    FROM frames),
  walk AS (
    SELECT key, rn, n, 0 AS wait, CAST(NULL AS BIGINT) AS st, CAST(NULL AS BIGINT) AS en, CAST(0 AS BIGINT) AS total,
      CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS start_pos, CAST(NULL AS BIGINT) AS end_pos, CAST(0 AS BIGINT) AS strength
    FROM steps WHERE rn = 1
    UNION ALL
    SELECT s.key, s.rn, s.n,
      CASE WHEN w.wait > 0 THEN w.wait - 1 WHEN s.q >= {high} THEN {rest} WHEN s.q >= {low} THEN 0 WHEN w.total >= {high} THEN {rest} ELSE 0 END,
      CASE WHEN w.wait = 0 AND s.q >= {low} AND s.q < {high} THEN coalesce(w.st, s.pos) END,
      CASE WHEN w.wait = 0 AND s.q >= {low} AND s.q < {high} THEN s.pos END,
      CASE WHEN w.wait = 0 AND s.q >= {low} AND s.q < {high} THEN w.total + s.q ELSE 0 END,
      CASE WHEN w.wait > 0 THEN NULL WHEN s.q >= {high} THEN 'cut' WHEN s.q < {low} AND w.total >= {high} THEN 'gradual' END,
      CASE WHEN s.q >= {high} THEN s.pos ELSE w.st END, CASE WHEN s.q >= {high} THEN s.pos ELSE w.en END,
      CASE WHEN s.q >= {high} THEN s.q ELSE w.total END
    FROM walk w JOIN steps s ON s.key = w.key AND s.rn = w.rn + 1)
  SELECT key, kind, start_pos, end_pos, strength FROM walk WHERE kind IS NOT NULL
  UNION ALL SELECT key, 'gradual', st, en, total FROM walk WHERE rn = n AND total >= {high}"""


@query("shot_transitions", sql_out(
    _TRANSITIONS_SQL.format(low=900_000, high=1_150_000, rest=2),
    [("key", "s"), ("kind", "s"), ("start_pos", "i"), ("end_pos", "i"), ("strength", "i")]))
def q_shot_transitions(spark, sf):
    """Cuts and gradual transitions by two thresholds (0.9 and 1.15 of 1 - cosine), two frames at rest after each."""
    e = read_table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("key"),
                                                  F.col("vec_id").alias("pos"),
                                                  F.col("embedding").cast("array<double>").alias("vec"))
    return finish(ts.shot_transitions(e, 0.9, 1.15, rest=2))


# ---------------------------------------------------------------------------
# D. aggregations

_PRED_CTE = _with(fx.FX_PRED_SQL)


def _metrics_sql(p: str) -> str:
    c = lambda a, b: f"sum(CASE WHEN y = {a} AND {p} = {b} THEN 1 ELSE 0 END)"
    c00, c01, c10, c11 = c(0, 0), c(0, 1), c(1, 0), c(1, 1)
    div = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"
    pr0, pr1 = f"({c00}+{c01}+{c10} > 0)", f"({c11}+{c01}+{c10} > 0)"

    def macro(a, b):
        return f"(CASE WHEN {pr0} AND {pr1} THEN ({a} + {b}) / 2.0 WHEN {pr0} THEN {a} WHEN {pr1} THEN {b} END)"
    rec0, rec1 = div(c00, f"{c00}+{c01}"), div(c11, f"{c11}+{c10}")
    return (f"count(*) AS n, {div(f'{c00}+{c11}', 'count(*)')} AS acc, "
            f"{macro(div(c00, f'{c00}+{c10}'), div(c11, f'{c11}+{c01}'))} AS precision, "
            f"{macro(rec0, rec1)} AS recall, {f1_expr('y', p)} AS f1, "
            f"CASE WHEN {c00}+{c01} > 0 AND {c10}+{c11} > 0 THEN ({rec0} + {rec1}) / 2.0 END AS auc")


_MCOLS = [("n", "i"), ("acc", "d"), ("precision", "d"), ("recall", "d"), ("f1", "d"), ("auc", "d")]


@query("binary_metrics", sql_out(f"SELECT lang, {_metrics_sql('p')} FROM fx_pred GROUP BY lang",
                                 [("lang", "s")] + _MCOLS, _PRED_CTE))
def q_binary_metrics(spark, sf):
    return finish(me.binary_metrics(fx.fx_pred(spark, sf), "y", "p", ["lang"]))


@query("auc_scores", sql_out(
    f"""SELECT h.lang, h.n, h.acc, h.precision, h.recall, h.f1, a.auc FROM
        (SELECT lang, {_metrics_sql('pr')} FROM (SELECT *, CAST(round_even(score, 0) AS INTEGER) AS pr FROM fx_pred)
         GROUP BY lang) h
        JOIN (SELECT lang, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN sum(pos * (negb + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc
              FROM (SELECT lang, score, pos, neg,
                      coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY score
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS negb
                    FROM (SELECT lang, score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                            sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg FROM fx_pred GROUP BY lang, score))
              GROUP BY lang) a USING (lang)""",
    [("lang", "s")] + _MCOLS, _PRED_CTE))
def q_auc_scores(spark, sf):
    return finish(me.auc_scores(fx.fx_pred(spark, sf), "y", "score", ["lang"])
                  .select("lang", "n", "acc", "precision", "recall", "f1", "auc"))


@query("metrics_three_classes", sql_out(
    """SELECT lang, n, acc, (SELECT avg(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END) FROM per p WHERE p.lang = t.lang) AS precision,
         (SELECT avg(CASE WHEN tr > 0 THEN tp / tr ELSE 0 END) FROM per p WHERE p.lang = t.lang) AS recall,
         (SELECT avg(2 * tp / (pr + tr)) FROM per p WHERE p.lang = t.lang) AS f1
       FROM (SELECT lang, count(*) AS n, avg(CASE WHEN y = p3 THEN 1.0 ELSE 0.0 END) AS acc FROM three GROUP BY lang) t""",
    [("lang", "s"), ("n", "i"), ("acc", "d"), ("precision", "d"), ("recall", "d"), ("f1", "d")], _PRED_CTE + """,
three AS (SELECT lang, y, CAST(round_even(3 * score, 0) AS INTEGER) AS p3 FROM fx_pred),
cls AS (SELECT DISTINCT lang, y AS c FROM three UNION SELECT DISTINCT lang, p3 FROM three),
per AS (SELECT c.lang, c.c, CAST(sum(CASE WHEN t.y = c.c AND t.p3 = c.c THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
          sum(CASE WHEN t.p3 = c.c THEN 1 ELSE 0 END) AS pr, sum(CASE WHEN t.y = c.c THEN 1 ELSE 0 END) AS tr
        FROM cls c JOIN three t ON t.lang = c.lang GROUP BY c.lang, c.c)"""))
def q_metrics_three_classes(spark, sf):
    """Scores stretched so that they round to four values: rows outside the two
    classes count too."""
    pred = fx.fx_pred(spark, sf).withColumn("p3", F.bround(F.lit(3) * F.col("score"), 0).cast("int"))
    return finish(me.class_metrics(pred, "y", "p3", ["lang"]))


@query("confusion_matrix", sql_out(
    "SELECT g.lang, c.y, c.p, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM fx_pred) g "
    "CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(y, p) "
    "LEFT JOIN (SELECT lang, y, p, count(*) AS n FROM fx_pred GROUP BY lang, y, p) n "
    "ON n.lang = g.lang AND n.y = c.y AND n.p = c.p",
    [("lang", "s"), ("y", "i"), ("p", "i"), ("n", "i")], _PRED_CTE))
def q_confusion_matrix(spark, sf):
    return finish(me.confusion_matrix(fx.fx_pred(spark, sf), "y", "p", ["lang"]))


def _report_sql() -> str:
    div = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"
    p0, p1 = div("c00", "c00 + c10"), div("c11", "c11 + c01")
    r0, r1 = div("c00", "c00 + c01"), div("c11", "c11 + c10")
    f0, f1 = div("2 * c00", "2 * c00 + c10 + c01"), div("2 * c11", "2 * c11 + c01 + c10")
    s0, s1, n = "(c00 + c01)", "(c10 + c11)", "(c00 + c01 + c10 + c11)"
    r = lambda v: f"round({v}, 4)"
    rows = [
        f"SELECT lang, 'real' AS label, {r(p0)} AS precision, {r(r0)} AS recall, {r(f0)} AS f1, {s0} AS support FROM cc",
        f"SELECT lang, 'fake', {r(p1)}, {r(r1)}, {r(f1)}, {s1} FROM cc",
        f"SELECT lang, 'accuracy', NULL, NULL, {r(div('c00 + c11', n))}, {n} FROM cc",
        f"SELECT lang, 'macro avg', {r(f'({p0} + {p1}) / 2')}, {r(f'({r0} + {r1}) / 2')}, {r(f'({f0} + {f1}) / 2')}, {n} FROM cc",
        f"SELECT lang, 'weighted avg', {r(div(f'{p0} * {s0} + {p1} * {s1}', n))}, {r(div(f'{r0} * {s0} + {r1} * {s1}', n))}, "
        f"{r(div(f'{f0} * {s0} + {f1} * {s1}', n))}, {n} FROM cc",
    ]
    return " UNION ALL ".join(rows)


_CC_SQL = """
cc AS (SELECT lang, sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS c00,
         sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS c01,
         sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS c10,
         sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS c11 FROM fx_pred GROUP BY lang)"""


@query("classification_report", sql_out(
    _report_sql(), [("lang", "s"), ("label", "s"), ("precision", "d"), ("recall", "d"), ("f1", "d"),
                    ("support", "i")], _with(fx.FX_PRED_SQL, _CC_SQL)))
def q_classification_report(spark, sf):
    return finish(me.classification_report(fx.fx_pred(spark, sf), "y", "p", ["lang"]))


def _report_three_sql() -> str:
    div = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"
    figures = lambda k: (div(f"c{k}", f"p{k}"), div(f"c{k}", f"s{k}"), div(f"2 * c{k}", f"s{k} + p{k}"))
    (p0, r0, f0), (p1, r1, f1) = figures(0), figures(1)
    r = lambda v: f"round({v}, 4)"
    w = lambda a, b: div(f"({a} * s0 + {b} * s1)", "s0 + s1")
    rows = [f"SELECT lang, 'real' AS label, {r(p0)} AS precision, {r(r0)} AS recall, {r(f0)} AS f1, s0 AS support FROM cc",
            f"SELECT lang, 'fake', {r(p1)}, {r(r1)}, {r(f1)}, s1 FROM cc",
            f"SELECT lang, 'accuracy', NULL, NULL, {r(div('hits', 'n'))}, n FROM cc",
            f"SELECT lang, 'macro avg', {r(f'({p0} + {p1}) / 2')}, {r(f'({r0} + {r1}) / 2')}, {r(f'({f0} + {f1}) / 2')}, s0 + s1 FROM cc",
            f"SELECT lang, 'weighted avg', {r(w(p0, p1))}, {r(w(r0, r1))}, {r(w(f0, f1))}, s0 + s1 FROM cc",
            "SELECT lang, 'outside', NULL, NULL, NULL, outside FROM cc WHERE outside > 0"]
    return " UNION ALL ".join(rows)


_CC_THREE_SQL = """
cc AS (SELECT lang, sum(CASE WHEN y = 0 AND p3 = 0 THEN 1 ELSE 0 END) AS c0, sum(CASE WHEN y = 1 AND p3 = 1 THEN 1 ELSE 0 END) AS c1,
         sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS s1,
         sum(CASE WHEN p3 = 0 THEN 1 ELSE 0 END) AS p0, sum(CASE WHEN p3 = 1 THEN 1 ELSE 0 END) AS p1,
         sum(CASE WHEN y = p3 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN p3 IN (0, 1) THEN 0 ELSE 1 END) AS outside, count(*) AS n
       FROM (SELECT lang, y, CAST(round_even(3 * score, 0) AS INTEGER) AS p3 FROM fx_pred) GROUP BY lang)"""


@query("report_three_classes", sql_out(
    _report_three_sql(), [("lang", "s"), ("label", "s"), ("precision", "d"), ("recall", "d"), ("f1", "d"), ("support", "i")],
    _with(fx.FX_PRED_SQL, _CC_THREE_SQL)))
def q_report_three_classes(spark, sf):
    """Predictions stretched to four values: rows of a third class count in
    every figure they touch and are reported."""
    pred = fx.fx_pred(spark, sf).withColumn("p3", F.bround(F.lit(3) * F.col("score"), 0).cast("int"))
    return finish(me.classification_report(pred, "y", "p3", ["lang"]))


_TRAIN_MODEL_SQL = f""",
tdims AS (SELECT y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d FROM items WHERE split = 'train'),
tmodel AS (SELECT y, d, sum(v) / count(*) AS c FROM tdims GROUP BY y, d),
odims AS (SELECT video_id, split, y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d
          FROM items WHERE split <> 'train'),
odot AS (SELECT o.video_id, o.split, o.y, m.y AS cls, sum(o.v * m.c) AS dp
         FROM odims o JOIN tmodel m USING (d) GROUP BY o.video_id, o.split, o.y, m.y),
ologits AS (
  SELECT video_id, split, y, coalesce(10.0 * max(CASE WHEN cls = 0 THEN dp END), 0.0) AS l0,
         coalesce(10.0 * max(CASE WHEN cls = 1 THEN dp END), 0.0) AS l1
  FROM odot GROUP BY video_id, split, y),
oscored AS (
  SELECT *, exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p0,
         exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p1,
         CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred FROM ologits)"""

_ITEMS_ONLY = fx.FX_ITEMS_SQL + """,
items AS (SELECT video_id, vec_id, split, source, CASE WHEN label = 'real' THEN 0 ELSE 1 END AS y, fea FROM fx_items)"""


def _train_scored(spark, sf):
    items = _items(spark, sf)
    model = tr.fit_centroids(items.filter(F.col("split") == "train"))
    return tr.score_centroids(model, items.filter(F.col("split") != "train"))


@query("mean_log_loss", sql_out(
    "SELECT split, avg(greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) "
    "- CASE WHEN y = 0 THEN l0 ELSE l1 END) AS log_loss, count(*) AS n FROM oscored GROUP BY split",
    [("split", "s"), ("log_loss", "d"), ("n", "i")], _with(_ITEMS_ONLY) + _TRAIN_MODEL_SQL))
def q_mean_log_loss(spark, sf):
    return finish(me.mean_log_loss(_train_scored(spark, sf), "logits", "y", ["split"]))


@query("uncertainty_scores", sql_out(
    "SELECT video_id, l0, l1, p1, -(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10)) AS entropy FROM oscored",
    [("video_id", "s"), ("l0", "d"), ("l1", "d"), ("p1", "d"), ("entropy", "d")],
    _with(_ITEMS_ONLY) + _TRAIN_MODEL_SQL))
def q_uncertainty_scores(spark, sf):
    s = _train_scored(spark, sf)
    return finish(s.select("video_id", F.col("logits")[0].alias("l0"), F.col("logits")[1].alias("l1"),
                           F.col("probs")[1].alias("p1"), "entropy"))


@query("model_scores", ORACLES["uncertainty_scores"])
def q_model_scores(spark, sf):
    """The pluggable scorer (J2): a numpy model object broadcast once and
    applied per Arrow batch; same numbers as the JVM centroid scorer."""
    items = _items(spark, sf)
    model = tr.fit_centroids(items.filter(F.col("split") == "train"))
    rows = sorted(model.select("y", "centroid").collect())  # classes x d: bounded
    scored = tr.score_with(items.filter(F.col("split") != "train").select("video_id", "fea"),
                           tr.CentroidArrayModel([r.centroid for r in rows]))
    return finish(scored.select("video_id", F.col("logits")[0].alias("l0"), F.col("logits")[1].alias("l1"),
                                F.col("probs")[1].alias("p1"), "entropy"))


@query("predict_class", sql_out(
    "SELECT video_id, split, y, pred FROM oscored",
    [("video_id", "s"), ("split", "s"), ("y", "i"), ("pred", "i")], _with(_ITEMS_ONLY) + _TRAIN_MODEL_SQL))
def q_predict_class(spark, sf):
    return finish(_train_scored(spark, sf).select("video_id", "split", "y", "pred"))


@query("linear_scores", sql_out(
    "SELECT o.video_id, sum(o.v * m0.c) - 0.5 * (SELECT sum(c * c) FROM tmodel WHERE y = 0) AS l0, "
    "sum(o.v * m1.c) - 0.5 * (SELECT sum(c * c) FROM tmodel WHERE y = 1) AS l1 "
    "FROM odims o JOIN tmodel m0 ON m0.d = o.d AND m0.y = 0 JOIN tmodel m1 ON m1.d = o.d AND m1.y = 1 "
    "GROUP BY o.video_id",
    [("video_id", "s"), ("l0", "d"), ("l1", "d")], _with(_ITEMS_ONLY) + _TRAIN_MODEL_SQL))
def q_linear_scores(spark, sf):
    """Nearest-centroid head written as a linear layer: w_c = centroid,
    b_c = -|centroid|^2 / 2."""
    items = _items(spark, sf)
    model = tr.fit_centroids(items.filter(F.col("split") == "train"))
    from ..functions.vectors import dot
    w = model.select(F.col("y").alias("cls"), F.col("centroid").alias("w"),
                     (F.lit(-0.5) * dot("centroid", "centroid")).alias("b"))
    s = tr.linear_scores(items.filter(F.col("split") != "train"), w)
    return finish(s.select("video_id", F.col("logits")[0].alias("l0"), F.col("logits")[1].alias("l1")))


_LOGREG_REG = 0.1


@query("logreg_fit", sql_out(
    "SELECT c.cls, d.d, 0.0 AS gradient FROM (SELECT CAST(range AS INTEGER) AS cls FROM range(2)) c CROSS JOIN "
    "(SELECT DISTINCT unnest(range(len(fea) + 1)) AS d FROM fx_items WHERE split <> 'train') d",
    [("cls", "i"), ("d", "i"), ("gradient", "d")], _with(fx.FX_ITEMS_SQL)))
def q_logreg_fit(spark, sf):
    """Multinomial logistic regression on every non-train item. The optimum is
    where the penalised loss has no slope: per class and dimension (the last
    one is the intercept) the gradient at the fitted point, to 3 decimals."""
    items = _items(spark, sf).filter(F.col("split") != "train")
    model = tr.fit_logreg(items, max_iter=500, reg=_LOGREG_REG, tol=1e-9)
    g = tr.logreg_gradient(model, items, reg=_LOGREG_REG)
    return finish(g.select("cls", "d", (F.round("gradient", 3) + F.lit(0.0)).alias("gradient")))


@query("sequence_mean_pool", sql_out(
    "SELECT key, 0 AS d, avg(x) AS mean FROM fixed83 GROUP BY key",
    [("key", "s"), ("d", "i"), ("mean", "d")], _with(fx.FX_SEQ_SQL, _fixed_sql("fixed83", "fx_seq", 83))))
def q_sequence_mean_pool(spark, sf):
    fixed = sq.fixed_length(fx.fx_seq(spark, sf), 83, ["x"]).withColumn("vec", F.array("x"))
    return finish(feat.sequence_mean_pool(fixed, ["key"], "vec").select("key", "d", "mean"))


@query("modality_mean_fusion", sql_out(
    "SELECT key, d, avg(mean) AS fused, count(*) AS n_modalities FROM ("
    "SELECT key, 0 AS d, avg(x) AS mean FROM fixed83 GROUP BY key UNION ALL "
    "SELECT key, 0 AS d, avg(x) AS mean FROM fixed50 GROUP BY key UNION ALL "
    "SELECT key, 0 AS d, avg(x) AS mean FROM fx_seq GROUP BY key) GROUP BY key, d",
    [("key", "s"), ("d", "i"), ("fused", "d"), ("n_modalities", "i")],
    _with(fx.FX_SEQ_SQL, _fixed_sql("fixed83", "fx_seq", 83), _fixed_sql("fixed50", "fx_seq", 50))))
def q_modality_mean_fusion(spark, sf):
    seq = fx.fx_seq(spark, sf)
    vec = lambda df: df.withColumn("vec", F.array("x"))
    pooled = [feat.sequence_mean_pool(vec(sq.fixed_length(seq, 83, ["x"])), ["key"], "vec"),
              feat.sequence_mean_pool(vec(sq.fixed_length(seq, 50, ["x"])), ["key"], "vec"),
              feat.sequence_mean_pool(vec(seq.withColumn("mask", F.lit(1))), ["key"], "vec")]
    return finish(feat.modality_mean_fusion(pooled, ["key"]))


@query("fabrication_stats", sql_out(
    "SELECT coalesce(fabrication_type, 'Total') AS fabrication_type, count(*) AS n FROM ("
    "SELECT CASE split_part(video_id, '_', 2) || '_' || split_part(video_id, '_', 3) "
    "WHEN 'TOVN_TOVM' THEN 'Misleading Substitution' WHEN 'TNVO_TMVO' THEN 'Groundless Fabrication' "
    "WHEN 'TOVO_TMVO' THEN 'Fact Distortion' WHEN 'TOVO_TOVM' THEN 'Selective Editing' END AS fabrication_type "
    "FROM fx_items WHERE strpos(video_id, '_') > 0) GROUP BY ROLLUP (fabrication_type)",
    [("fabrication_type", "s"), ("n", "i")], _with(fx.FX_ITEMS_SQL)))
def q_fabrication_stats(spark, sf):
    return finish(st.fabrication_stats(fx.fx_items(spark, sf)))


@query("fabrication_stats_by_dataset", sql_out(
    "SELECT dataset, coalesce(fabrication_type, 'Total') AS fabrication_type, count(*) AS n FROM ("
    "SELECT CASE WHEN vec_id % 2 = 0 THEN 'fakett' ELSE 'fakesv' END AS dataset, fabrication_type FROM fx_items JOIN ("
    + _FAB_SQL.strip() + ") USING (video_id) WHERE fabrication_type IS NOT NULL) "
    "GROUP BY GROUPING SETS ((dataset, fabrication_type), (dataset))",
    [("dataset", "s"), ("fabrication_type", "s"), ("n", "i")], _with(fx.FX_ITEMS_SQL)))
def q_fabrication_stats_by_dataset(spark, sf):
    it = fx.fx_items(spark, sf).withColumn("dataset", F.when(F.col("vec_id") % 2 == 0, F.lit("fakett")).otherwise(F.lit("fakesv")))
    return finish(st.fabrication_stats(it, ["dataset"]))


@query("category_share", sql_out(
    "SELECT user_id, event_type, n, n / sum(n) OVER (PARTITION BY user_id) AS share FROM "
    "(SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)",
    [("user_id", "i"), ("event_type", "s"), ("n", "i"), ("share", "d")]))
def q_category_share(spark, sf):
    return finish(st.category_share(read_table(spark, sf, "events"), ["user_id"], "event_type"))


@query("source_share", sql_out(
    "SELECT lang, source, n, n / sum(n) OVER (PARTITION BY lang) AS share FROM "
    "(SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)",
    [("lang", "s"), ("source", "s"), ("n", "i"), ("share", "d")]))
def q_source_share(spark, sf):
    return finish(st.category_share(read_table(spark, sf, "documents"), ["lang"], "source"))


@query("score_share", sql_out(
    "SELECT event_type, count(*) AS n, avg(CASE WHEN value >= 3 THEN 1.0 ELSE 0.0 END) AS share "
    "FROM events GROUP BY event_type",
    [("event_type", "s"), ("n", "i"), ("share", "d")]))
def q_score_share(spark, sf):
    return finish(st.score_share(read_table(spark, sf, "events"), ["event_type"], "value", 3))


@query("scores_dedup", sql_out(
    "SELECT user_id, arg_max(event_id, struct_pack(ts, event_id)) AS event_id, "
    "arg_max(value, struct_pack(ts, event_id)) AS value FROM events GROUP BY user_id",
    [("user_id", "i"), ("event_id", "i"), ("value", "d")]))
def q_scores_dedup(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "event_id", "value",
                                               F.struct("ts", "event_id").alias("_order"))
    return finish(st.dedup_last(ev, "user_id", "_order").select("user_id", "event_id", "value"))


@query("quality_gate", sql_out(
    "SELECT doc_id, lang, n_chars FROM documents d WHERE EXISTS "
    "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)",
    [("doc_id", "i"), ("lang", "s"), ("n_chars", "i")]))
def q_quality_gate(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return finish(po.quality_gate(d, read_table(spark, sf, "labels")))


@query("early_stop", sql_out(
    """SELECT run_id, stop_epoch, best_epoch, best_f1, best_f1 > 0.6 AS is_final, stopped FROM (
         SELECT h.run_id, h.epoch AS stop_epoch, h.best_ep AS best_epoch, h.best_f1, s.se IS NOT NULL AS stopped
         FROM (SELECT *, coalesce(max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS best_ep,
                      greatest(prev, f1) AS best_f1
               FROM (SELECT *, f1 > prev AS imp FROM (
                       SELECT *, coalesce(max(f1) OVER (PARTITION BY run_id ORDER BY epoch
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev
                       FROM fx_history))) h
         JOIN (SELECT run_id, min(CASE WHEN stop THEN epoch END) AS se, max(epoch) AS last FROM (
                 SELECT *, NOT imp AND epoch - best_ep >= 5 AS stop FROM (
                   SELECT *, coalesce(max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS best_ep
                   FROM (SELECT *, f1 > prev AS imp FROM (
                           SELECT *, coalesce(max(f1) OVER (PARTITION BY run_id ORDER BY epoch
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev
                           FROM fx_history)))) GROUP BY run_id) s USING (run_id)
         WHERE h.epoch = coalesce(s.se, s.last))""",
    [("run_id", "i"), ("stop_epoch", "i"), ("best_epoch", "i"), ("best_f1", "d"), ("is_final", "b"),
     ("stopped", "b")], _with(fx.FX_HISTORY_SQL)))
def q_early_stop(spark, sf):
    return finish(tr.early_stop(fx.fx_history(spark, sf), patience=5, threshold=0.6))


# ---------------------------------------------------------------------------
# E/F. folds, orders, samples

@query("kfold_assign", sql_out("SELECT video_id, fold FROM folds", [("video_id", "s"), ("fold", "i")],
                               _with(AL_BASE)))
def q_kfold_assign(spark, sf):
    ids = fx.fx_items(spark, sf).filter(F.col("split") == "train").select("video_id")
    return finish(fo.kfold(ids, 5, 2025))


@query("fold_roles", sql_out(
    "SELECT f.video_id, f.fold, r.run AS run_fold, CASE WHEN r.run = f.fold THEN 'val' ELSE 'train' END AS role "
    "FROM folds f CROSS JOIN runs r",
    [("video_id", "s"), ("fold", "i"), ("run_fold", "i"), ("role", "s")], _with(AL_BASE)))
def q_fold_roles(spark, sf):
    ids = fx.fx_items(spark, sf).filter(F.col("split") == "train").select("video_id")
    return finish(fo.fold_roles(fo.kfold(ids, 5, 2025), 5).select("video_id", "fold", "run_fold", "role"))


@query("seeded_order", sql_out(
    "SELECT video_id, row_number() OVER (ORDER BY md5('2025:' || video_id), video_id) AS ord FROM fx_items",
    [("video_id", "s"), ("ord", "i")], _with(fx.FX_ITEMS_SQL)))
def q_seeded_order(spark, sf):
    return finish(fo.seeded_order(fx.fx_items(spark, sf).select("video_id"), 2025))


@query("random_baseline", sql_out(
    "SELECT fold, video_id FROM (SELECT r.run AS fold, p.video_id, row_number() OVER (PARTITION BY r.run "
    "ORDER BY md5('2025:' || r.run || ':' || p.video_id), p.video_id) AS rn FROM pool p CROSS JOIN runs r) "
    "WHERE rn <= (SELECT k FROM kpar)",
    [("fold", "i"), ("video_id", "s")], _with(AL_BASE)))
def q_random_baseline(spark, sf):
    data, cfg = _al_data(spark, sf)
    pool = data.pool.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.k_folds - 1))).alias("fold"))
    return finish(fo.random_sample(pool, data.k, 2025, by=["fold"]).select("fold", "video_id"))


# ---------------------------------------------------------------------------
# K. selection rounds (one plan for all folds)

_R1 = loop_sql(1)


@query("uncertainty_anchors", sql_out(
    "SELECT fold, video_id, entropy, rn AS rank FROM (SELECT fold, video_id, "
    "-(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10)) AS entropy, "
    "row_number() OVER (PARTITION BY fold ORDER BY -(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10)) DESC, video_id) AS rn, "
    "count(*) OVER (PARTITION BY fold) AS nf FROM val_0) WHERE rn <= floor(nf * 0.3)",
    [("fold", "i"), ("video_id", "s"), ("entropy", "d"), ("rank", "i")], _R1))
def q_uncertainty_anchors(spark, sf):
    data, cfg = _al_data(spark, sf)
    anchors = al.round_anchors(data, data.init_sums, cfg)
    order = [F.col("entropy").desc(), F.col("video_id").asc()]
    return finish(rank_within(anchors.select("fold", "video_id", "entropy"), order, by=["fold"], groups_bounded=True))


@query("max_anchor_similarity", sql_out(
    "SELECT fold, video_id, similarity FROM sim_0", [("fold", "i"), ("video_id", "s"), ("similarity", "d")], _R1))
def q_max_anchor_similarity(spark, sf):
    data, cfg = _al_data(spark, sf)
    anchors = al.round_anchors(data, data.init_sums, cfg)
    sims = al.round_similarity(data, anchors, al.empty_state(spark), cfg)
    return finish(sims.select("fold", "video_id", "similarity"))


@query("topk_similarity", sql_out(
    "SELECT fold, video_id, similarity, rn AS rank FROM sel_0",
    [("fold", "i"), ("video_id", "s"), ("similarity", "d"), ("rank", "i")], _R1))
def q_topk_similarity(spark, sf):
    _, _, rnd = _round0(spark, sf)
    order = [F.col("similarity").desc(), F.col("video_id").asc()]
    return finish(rank_within(rnd["selected"].select("fold", "video_id", "similarity"), order, by=["fold"], groups_bounded=True))


@query("drop_half", sql_out(
    "SELECT fold, video_id FROM (SELECT fold, video_id, row_number() OVER (PARTITION BY fold "
    "ORDER BY md5('2025:' || fold || ':0:' || video_id), video_id) AS rn, count(*) OVER (PARTITION BY fold) AS nf "
    "FROM sel_0) WHERE rn <= nf // 2",
    [("fold", "i"), ("video_id", "s")], _R1))
def q_drop_half(spark, sf):
    _, cfg, rnd = _round0(spark, sf)
    return finish(fo.drop_half(rnd["selected"].select("fold", "iteration", "video_id"), cfg.seed)
                  .select("fold", "video_id"))


@query("al_round", sql_out(
    "SELECT s.fold, s.video_id, s.similarity, d.accepted, d.cur_f1, d.new_f1 FROM sel_0 s JOIN dec_0 d USING (fold)",
    [("fold", "i"), ("video_id", "s"), ("similarity", "d"), ("accepted", "b"), ("cur_f1", "d"), ("new_f1", "d")], _R1))
def q_al_round(spark, sf):
    _, _, rnd = _round0(spark, sf)
    d = rnd["decisions"].select("fold", "accepted", "cur_f1", "new_f1")
    return finish(rnd["selected"].join(d, "fold").select("fold", "video_id", "similarity", "accepted",
                                                         "cur_f1", "new_f1"))


@query("al_round_duplicate_ids", sql_out(
    "SELECT s.fold, s.video_id, s.similarity, d.accepted, d.new_f1, d.n_candidates FROM sel_0 s JOIN dec_0 d USING (fold)",
    [("fold", "i"), ("video_id", "s"), ("similarity", "d"), ("accepted", "b"), ("new_f1", "d"), ("n_candidates", "i")],
    _R1.replace("sel_0 s JOIN pool_dims p USING (video_id)", "sel_0 s JOIN (SELECT * FROM pool_dims UNION ALL "
                "SELECT * FROM pool_dims) p USING (video_id)")))
def q_al_round_duplicate_ids(spark, sf):
    """Every pool item twice in the manifest: an id is a candidate once and
    selected once, but both of its rows train the next model."""
    items = fx.fx_items(spark, sf)
    twice = items.unionByName(items.filter(F.col("split") == "gen"))
    ids = lambda split: items.filter(F.col("split") == split).select("video_id")
    cfg = al.ALConfig()
    data = al.prepare(twice, ids("train"), ids("test"), fx.fx_seed_ids(spark, sf), cfg)
    rnd = al.al_round(data, al.begin(data, cfg), 0, cfg)
    d = rnd["decisions"].select("fold", "accepted", "new_f1", "n_candidates")
    return finish(rnd["selected"].join(d, "fold").select("fold", "video_id", "similarity", "accepted", "new_f1", "n_candidates"))


_PROJECTED = ("list_transform(range(1, 33), lambda i: greatest(embedding[CAST(i AS INTEGER)] :: DOUBLE "
              "- 0.5 * (embedding[CAST(i + 32 AS INTEGER)] :: DOUBLE), 0.0))")


def half_difference(x):
    """A small user model: a linear projection to half the width, then ReLU."""
    import numpy as np
    d = x.shape[1] // 2
    return np.maximum(x[:, :d] - 0.5 * x[:, d:2 * d], 0.0)


@query("al_round_model", sql_out(
    "SELECT s.fold, s.video_id, s.similarity, d.accepted, d.cur_f1, d.new_f1 FROM sel_0 s JOIN dec_0 d USING (fold)",
    [("fold", "i"), ("video_id", "s"), ("similarity", "d"), ("accepted", "b"), ("cur_f1", "d"), ("new_f1", "d")],
    _R1.replace("CAST(embedding AS DOUBLE[]) AS fea", f"{_PROJECTED} AS fea")))
def q_al_round_model(spark, sf):
    """A round under a user's vector model: anchors, pool and test vectors all
    come from it."""
    items = fx.fx_items(spark, sf)
    ids = lambda split: items.filter(F.col("split") == split).select("video_id")
    cfg = al.ALConfig()
    data = al.prepare(items, ids("train"), ids("test"), fx.fx_seed_ids(spark, sf), cfg, al.ProjectedHead(half_difference, cfg.scale))
    rnd = al.al_round(data, al.begin(data, cfg), 0, cfg)
    d = rnd["decisions"].select("fold", "accepted", "cur_f1", "new_f1")
    return finish(rnd["selected"].join(d, "fold").select("fold", "video_id", "similarity", "accepted", "cur_f1", "new_f1"))


_EPOCHS, _LR, _CLIP = 5, 4.0, 1.0


@query("al_round_iterative", sql_out(
    "SELECT s.fold, s.video_id, s.similarity, n.f1 > c.f1 AS accepted, c.f1 AS cur_f1, n.f1 AS new_f1, "
    "c.epoch AS first_epoch, n.epoch AS best_epoch FROM sel_0 s JOIN first_best c USING (fold) JOIN second_best n USING (fold)",
    [("fold", "i"), ("video_id", "s"), ("similarity", "d"), ("accepted", "b"), ("cur_f1", "d"), ("new_f1", "d"),
     ("first_epoch", "i"), ("best_epoch", "i")], iterative_round_sql(_EPOCHS, _LR, _CLIP)))
def q_al_round_iterative(spark, sf):
    """A round under the head with epochs: fitted on the training folds, then
    from the accepted weights with the selection added; each fold keeps its
    best epoch by validation F1, as :func:`early_stop` finds it in the
    history."""
    items = fx.fx_items(spark, sf)
    ids = lambda split: items.filter(F.col("split") == split).select("video_id")
    cfg, head = al.ALConfig(), al.SoftmaxHead(al.EpochParams(epochs=_EPOCHS, lr=_LR, clip=_CLIP))
    data = al.prepare(items, ids("train"), ids("test"), fx.fx_seed_ids(spark, sf), cfg, head)
    rnd = al.al_round(data, al.begin(data, cfg), 0, cfg)
    best = []
    for i, name in ((0, "first_epoch"), (-1, "best_epoch")):
        history = spark.createDataFrame(head.histories[i], "run_id int, epoch int, loss double, f1 double")
        best.append(tr.early_stop(history, head.params.patience, head.params.threshold)
                    .select(F.col("run_id").alias("fold"), F.col("best_epoch").alias(name)))
    d = rnd["decisions"].select("fold", "accepted", "cur_f1", "new_f1").join(best[0], "fold").join(best[1], "fold")
    return finish(rnd["selected"].join(d, "fold").select("fold", "video_id", "similarity", "accepted", "cur_f1", "new_f1",
                                                         "first_epoch", "best_epoch"))


@query("assemble_round", sql_out(
    "SELECT s.fold, s.video_id, round(s.similarity, 4) AS similarity, d.accepted FROM sel_0 s JOIN dec_0 d USING (fold)",
    [("fold", "i"), ("video_id", "s"), ("similarity", "d"), ("accepted", "b")],
    _R1.replace(fx.FX_ITEMS_SQL.strip(), fx.FX_FUSED_SQL.strip(), 1)))
def q_assemble_round(spark, sf):
    """The whole data path: manifest and stores written and read, four
    modalities assembled, pooled and fused, then a selection round."""
    m, wide = fx.fx_wide_manifest(spark, sf), fx.fx_wide(spark, sf)
    path = scratch_path(spark, "manifest")
    m.write.json(path)
    items = io.read_manifest(spark, path)
    own = fx.fx_items(spark, sf).select(F.col("video_id").alias("key"), F.lit(0).alias("pos"),
                                       F.col("fea").cast("array<float>").alias("vec"))
    stores = {}
    for name, df in (("text", own), ("audio", wide), ("frames", wide), ("motion", own)):
        at = scratch_path(spark, f"store-{name}")
        df.write.parquet(at)
        stores[name] = io.read_feature_store(spark, at)
    fused = feat.fused_items(items, stores)
    base = fx.fx_items(spark, sf)
    ids = lambda split: base.filter(F.col("split") == split).select("video_id")
    cfg = al.ALConfig()
    data = al.prepare(items.join(fused, "video_id"), ids("train"), ids("test"), fx.fx_seed_ids(spark, sf), cfg)
    rnd = al.al_round(data, al.begin(data, cfg), 0, cfg)
    d = rnd["decisions"].select("fold", "accepted")
    return finish(rnd["selected"].join(d, "fold").select("fold", "video_id", F.round("similarity", 4).alias("similarity"), "accepted"))


@query("accept_reject", sql_out(
    "SELECT d.fold, d.cur_f1, d.new_f1, d.cur_test_f1, d.new_test_f1, d.accepted, d.n_candidates, d.n_selected, "
    "coalesce(u.n_useful, 0) AS n_useful, coalesce(u.n_useless, 0) AS n_useless FROM dec_0 d LEFT JOIN "
    "(SELECT fold, sum(CASE WHEN status = 'useful' THEN 1 ELSE 0 END) AS n_useful, "
    "sum(CASE WHEN status = 'useless' THEN 1 ELSE 0 END) AS n_useless FROM state_1 GROUP BY fold) u USING (fold)",
    [("fold", "i"), ("cur_f1", "d"), ("new_f1", "d"), ("cur_test_f1", "d"), ("new_test_f1", "d"),
     ("accepted", "b"), ("n_candidates", "i"), ("n_selected", "i"), ("n_useful", "i"), ("n_useless", "i")], _R1))
def q_accept_reject(spark, sf):
    _, cfg, rnd = _round0(spark, sf)
    state = al.apply_decision(rnd, cfg).state
    u = state.groupBy("fold").agg(F.sum(F.when(F.col("status") == "useful", 1).otherwise(0)).alias("n_useful"),
                                  F.sum(F.when(F.col("status") == "useless", 1).otherwise(0)).alias("n_useless"))
    d = rnd["decisions"].join(u, "fold", "left").fillna(0, ["n_useful", "n_useless"])
    return finish(d.select("fold", "cur_f1", "new_f1", "cur_test_f1", "new_test_f1", "accepted",
                           "n_candidates", "n_selected", "n_useful", "n_useless"))


@query("pool_counters", sql_out(
    "SELECT d.fold, (SELECT count(*) FROM train t WHERE t.fold <> d.fold) "
    "+ CASE WHEN d.accepted THEN d.n_selected ELSE 0 END AS train_size, "
    "(SELECT count(*) FROM pool) - coalesce((SELECT count(*) FROM state_1 s WHERE s.fold = d.fold), 0) AS valid_pool_size "
    "FROM dec_0 d",
    [("fold", "i"), ("train_size", "i"), ("valid_pool_size", "i")], _R1))
def q_pool_counters(spark, sf):
    data, cfg, rnd = _round0(spark, sf)
    after = al.apply_decision(rnd, cfg)
    sums, state = after.model, after.state
    train_size = sums.groupBy("fold").agg(F.sum("n").alias("train_size"))
    used = po.pool_counters(state).withColumnRenamed("n", "_used")
    n_pool = data.pool.count()
    out = (rnd["decisions"].select("fold").join(train_size, "fold", "left").join(used, "fold", "left")
           .fillna(0, ["_used"]).withColumn("valid_pool_size", F.lit(n_pool) - F.col("_used")))
    return finish(out.select("fold", "train_size", "valid_pool_size"))


@query("train_set", sql_out(
    "SELECT r.run AS fold, t.video_id FROM train t JOIN runs r ON t.fold <> r.run UNION ALL "
    "SELECT s.fold, s.video_id FROM sel_0 s JOIN dec_0 d ON d.fold = s.fold AND d.accepted",
    [("fold", "i"), ("video_id", "s")], _R1))
def q_train_set(spark, sf):
    data, cfg, rnd = _round0(spark, sf)
    base = fo.fold_roles(data.train.select("video_id", "fold"), cfg.k_folds) \
        .filter(F.col("role") == "train").select(F.col("run_fold").alias("fold"), "video_id")
    acc = rnd["decisions"].filter("accepted").select("fold")
    sel = rnd["selected"].join(acc, "fold", "left_semi").select("fold", "video_id")
    return finish(po.train_set(base, sel))


@query("majority_vote", sql_out(
    "SELECT video_id, count(DISTINCT fold) AS votes FROM sel_0 GROUP BY video_id HAVING count(DISTINCT fold) >= 3",
    [("video_id", "s"), ("votes", "i")], _R1))
def q_majority_vote(spark, sf):
    _, cfg, rnd = _round0(spark, sf)
    sel = rnd["selected"].withColumn("status", F.lit("useful"))
    return finish(al.majority_vote(sel, cfg.min_votes))


_LOOP_ROUNDS = 6
_R6 = loop_sql(_LOOP_ROUNDS)


@query("al_loop", sql_out(
    f"SELECT fold, video_id, status, iteration FROM state_{_LOOP_ROUNDS}",
    [("fold", "i"), ("video_id", "s"), ("status", "s"), ("iteration", "i")], _R6))
def q_al_loop(spark, sf):
    data, cfg = _al_data(spark, sf)
    out = al.al_loop(data, cfg, _LOOP_ROUNDS)
    return finish(out["state"].select("fold", "video_id", "status", "iteration"))


_FINAL_SQL = f""",
voted AS (SELECT video_id FROM state_{_LOOP_ROUNDS} WHERE status = 'useful'
          GROUP BY video_id HAVING count(DISTINCT fold) >= 3),
ftrain AS (SELECT video_id, y, fea FROM train UNION ALL SELECT p.video_id, p.y, p.fea FROM pool p JOIN voted USING (video_id)),
fdims AS (SELECT y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d FROM ftrain),
fmodel AS (SELECT y, d, sum(v) / count(*) AS c FROM fdims GROUP BY y, d),
tstd AS (SELECT split, video_id, y, unnest(fea) AS v, unnest(generate_series(1, len(fea))) AS d FROM items
         WHERE split IN ('test', 'val')),
tdot AS (SELECT t.split, t.video_id, t.y, m.y AS cls, sum(t.v * m.c) AS dp FROM tstd t JOIN fmodel m USING (d)
         GROUP BY t.split, t.video_id, t.y, m.y),
tpred AS (SELECT split, video_id, y, CASE WHEN coalesce(max(CASE WHEN cls = 1 THEN dp END), 0.0)
                                      > coalesce(max(CASE WHEN cls = 0 THEN dp END), 0.0) THEN 1 ELSE 0 END AS p
          FROM tdot GROUP BY split, video_id, y)"""


@query("final_metrics", sql_out(
    f"SELECT split, (SELECT count(*) FROM voted) AS n_voted, {_metrics_sql('p')} FROM tpred GROUP BY split",
    [("split", "s"), ("n_voted", "i")] + _MCOLS, _R6 + _FINAL_SQL))
def q_final_metrics(spark, sf):
    """The final fit's figures on the test ids and on the original validation
    list, which no fold has used."""
    data, cfg = _al_data(spark, sf)
    val = _items(spark, sf).filter(F.col("split") == "val").select("video_id", "y", "fea")
    res = al.cross_validated_selection(data, cfg, val)
    n_voted = res["voted"].count()
    both = res["test_metrics"].withColumn("split", F.lit("test")).unionByName(
        res["val_metrics"].withColumn("split", F.lit("val")))
    return finish(both.withColumn("n_voted", F.lit(n_voted))
                  .select("split", "n_voted", "n", "acc", "precision", "recall", "f1", "auc"))


@query("voted_ids_sink", sql_out(
    f"SELECT 'voted' AS kind, -1 AS fold, -1 AS iteration, video_id FROM voted UNION ALL "
    f"SELECT 'accepted', fold, iteration, video_id FROM ("
    + " UNION ALL ".join(f"SELECT s.fold, {r} AS iteration, s.video_id FROM sel_{r} s JOIN dec_{r} d USING (fold) WHERE d.accepted"
                         for r in range(_LOOP_ROUNDS)) + ")",
    [("kind", "s"), ("fold", "i"), ("iteration", "i"), ("video_id", "s")], _R6 + _FINAL_SQL))
def q_voted_ids_sink(spark, sf):
    """The loop's sinks: accepted ids by fold and round, voted ids; both
    written and read back."""
    data, cfg = _al_data(spark, sf)
    accepted, voted = scratch_path(spark, "accepted"), scratch_path(spark, "voted")
    out = al.al_loop(data, cfg, _LOOP_ROUNDS, ids_path=accepted)
    io.overwrite_ids(al.majority_vote(out["state"], cfg.min_votes), voted)
    v = io.read_version(spark, voted).select(F.lit("voted").alias("kind"), F.lit(-1).alias("fold"), F.lit(-1).alias("iteration"), "video_id")
    if not any(r.accepted for r in out["decisions"].collect()):
        return finish(v)
    a = io.read_version(spark, accepted).select(F.lit("accepted").alias("kind"), "fold", "iteration", "video_id")
    return finish(v.unionByName(a))


@query("quality_gate_learned")
def q_quality_gate_learned(spark, sf):
    """All documents decided: labelled ones by their label, the others by a
    classifier learned from the labelled ones. (Not SQL; tested on held-out
    rows.)"""
    out = gate.learned_gate(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    return finish(out.select("doc_id", "decided_by", "kept", "score"))
