"""Stand-in inputs derived from the given tables (FIXTURES.md §3).

Each fixture exists twice: as a DataFrame builder (what the Spark queries
run) and as SQL text (inlined as a CTE by the DuckDB oracle of every query
that needs it). Both read the whole base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..session import read_table

# --- fixed values of the stand-in manifest --------------------------------
# fabrication code of a generated item, by vec_id % 12
FX_CODES = {2: "TOVN_TOVM", 5: "TNVO_TMVO", 8: "TOVO_TMVO"}
FX_CODE_OTHER = "TOVO_TOVM"
# ---------------------------------------------------------------------------


def _code(v):
    c = F.when((v % 12) == 2, F.lit(FX_CODES[2]))
    for m in (5, 8):
        c = c.when((v % 12) == m, F.lit(FX_CODES[m]))
    return c.otherwise(F.lit(FX_CODE_OTHER))


def fx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, video_id, source, label, split, fea (ARRAY<DOUBLE>)."""
    e = read_table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    gen = (v % 3) == 2
    return e.select(
        v,
        F.when(gen, F.concat((v - 1).cast("string"), F.lit("_"), _code(v)))
        .otherwise(v.cast("string")).alias("video_id"),
        F.when(gen, F.concat(F.lit("Generated_"), _code(v))).otherwise(F.lit("Human")).alias("source"),
        F.when(gen | ((F.col("label") % 2) == 1), F.lit("fake")).otherwise(F.lit("real")).alias("label"),
        F.when(gen, F.lit("gen")).when((v % 15) == 10, F.lit("val"))
        .when((v % 15).isin(12, 13), F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.col("embedding").cast("array<double>").alias("fea"),
    )


def fx_seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed list for the pool filter: ids with vec_id % 15 = 13."""
    return fx_items(spark, sf_dir).filter((F.col("vec_id") % 15) == 13).select("video_id")


def fx_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, pos (0-based), x: one-wide frame sequences from events. Positions
    come from the skew-safe two-level rank (a hot user is split across
    tasks)."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    r = rank_within(ev, [F.col("ts").asc(), F.col("event_id").asc()], by=["user_id"], name="_r")
    return r.select(F.col("user_id").cast("string").alias("key"),
                    (F.col("_r") - 1).cast("int").alias("pos"), F.col("value").alias("x"))


def fx_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, material_pos (1-based), clip: every line of every order is a
    clip of the order's item. An order has at most seven lines, so the
    per-order window is bounded."""
    li = read_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                                  "l_quantity", "l_extendedprice")
    s = (F.col("l_partkey") * 7) % 100
    return li.select(
        F.col("l_orderkey").alias("item_id"),
        F.row_number().over(w).alias("material_pos"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit("_S"), s.cast("string"), F.lit("_E"),
                 (s + F.col("l_quantity").cast("int")).cast("string")).alias("clip"))


def fx_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", "lang", "source", (F.lit(1) - F.col("quality")).alias("y"),
                    F.when(F.col("n_chars") < 600, 1).otherwise(0).alias("p"),
                    F.round(F.lit(600.0) / (F.lit(600) + F.col("n_chars")), 2).alias("score"))


def fx_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    r = rank_within(ev, [F.col("ts").asc(), F.col("event_id").asc()], by=["user_id"], name="epoch")
    return r.select(F.col("user_id").alias("run_id"), "epoch",
                    F.round(F.col("value") / (F.col("value") + 10), 4).alias("f1"))


def n_users(spark: SparkSession, sf_dir: str) -> int:
    """Number of event users (= fx_seq sequences); users are numbered densely."""
    return int(read_table(spark, sf_dir, "events").agg(F.countDistinct("user_id")).first()[0])


def fx_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows (the reference's JSON-lines schema) for the stand-in
    items: materials are one to three clips of the fx_seq sequences."""
    it = fx_items(spark, sf_dir)
    u = n_users(spark, sf_dir)
    v = F.col("vec_id")
    src = lambda off: ((v + off) % u).cast("string")
    def clip(off, s, e):
        return F.concat(src(off), F.lit("_S"), s.cast("string"), F.lit("_E"), e.cast("string"))
    m1 = clip(0, F.lit(0), (v % 40) + 5)
    m2 = clip(7, v % 30, (v % 30) + 20)
    m3 = clip(13, (v % 50) + 10, (v % 50) + 60)
    mats = F.when((v % 3) == 0, F.array(m1)).when((v % 3) == 1, F.array(m1, m2)).otherwise(F.array(m1, m2, m3))
    return it.select(
        "video_id",
        F.concat(F.lit("title "), v.cast("string")).alias("title"),
        F.when((v % 4) == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ocr "), v.cast("string"))).alias("ocr"),
        mats.alias("visual_materials"), "label", "source")


def fx_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, pos, vec: wide frame sequences, one per embedding label."""
    e = read_table(spark, sf_dir, "embeddings")
    r = rank_within(e.select("label", "vec_id"), [F.col("vec_id").asc()], by=["label"], name="_r")
    return (r.select("vec_id", (F.col("_r") - 1).cast("int").alias("pos")).join(e, "vec_id")
            .select(F.col("label").cast("string").alias("key"), "pos", F.col("embedding").alias("vec")))


def fx_wide_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows whose materials are clips of :func:`fx_wide`."""
    n = int(read_table(spark, sf_dir, "embeddings").agg(F.countDistinct("label")).first()[0])
    v = F.col("vec_id")
    clip = lambda off, s, e: F.concat(((v + off) % n).cast("string"), F.lit("_S"), s.cast("string"),
                                      F.lit("_E"), e.cast("string"))
    one, two = clip(0, v % 5, v % 5 + 3), clip(3, F.lit(0), v % 90)
    mats = F.when(v % 3 == 1, F.array(one, two)).otherwise(F.array(one))
    it = fx_items(spark, sf_dir)
    return it.select("video_id", F.concat(F.lit("title "), v.cast("string")).alias("title"),
                     F.lit(None).cast("string").alias("ocr"), mats.alias("visual_materials"), "label", "source")


# ---------------------------------------------------------------------------
# SQL text of the same fixtures, for the DuckDB oracles.

# fixed values: the fabrication codes, as in FX_CODES
_CODE_SQL = ("CASE vec_id % 12 WHEN 2 THEN 'TOVN_TOVM' WHEN 5 THEN 'TNVO_TMVO' "
             "WHEN 8 THEN 'TOVO_TMVO' ELSE 'TOVO_TOVM' END")

FX_ITEMS_SQL = f"""
fx_items AS (
  SELECT vec_id,
    CASE WHEN vec_id % 3 = 2 THEN concat(CAST(vec_id - 1 AS VARCHAR), '_', {_CODE_SQL})
         ELSE CAST(vec_id AS VARCHAR) END AS video_id,
    CASE WHEN vec_id % 3 = 2 THEN concat('Generated_', {_CODE_SQL}) ELSE 'Human' END AS source,
    CASE WHEN vec_id % 3 = 2 OR label % 2 = 1 THEN 'fake' ELSE 'real' END AS label,
    CASE WHEN vec_id % 3 = 2 THEN 'gen' WHEN vec_id % 15 = 10 THEN 'val'
         WHEN vec_id % 15 IN (12, 13) THEN 'test' ELSE 'train' END AS split,
    CAST(embedding AS DOUBLE[]) AS fea
  FROM embeddings)"""

FX_SEQ_SQL = """
fx_seq AS (
  SELECT CAST(user_id AS VARCHAR) AS key,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
    value AS x
  FROM events)"""

FX_CLIPS_SQL = """
fx_clips AS (
  SELECT l_orderkey AS item_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                       l_quantity, l_extendedprice) AS material_pos,
    concat(CAST(l_suppkey AS VARCHAR), '_S', CAST((l_partkey * 7) % 100 AS VARCHAR),
           '_E', CAST((l_partkey * 7) % 100 + CAST(l_quantity AS INTEGER) AS VARCHAR)) AS clip
  FROM lineitem)"""

FX_PRED_SQL = """
fx_pred AS (
  SELECT d.doc_id, d.lang, d.source, 1 - l.quality AS y,
    CASE WHEN d.n_chars < 600 THEN 1 ELSE 0 END AS p,
    round(600.0E0 / (600 + d.n_chars), 2) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

FX_HISTORY_SQL = """
fx_history AS (
  SELECT user_id AS run_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
    round(value / (value + 10), 4) AS f1
  FROM events)"""

NU = "(SELECT count(DISTINCT user_id) FROM events)"

FX_MANIFEST_SQL = FX_ITEMS_SQL + f""",
fx_manifest AS (
  SELECT video_id, concat('title ', CAST(vec_id AS VARCHAR)) AS title,
    CASE WHEN vec_id % 4 = 0 THEN NULL ELSE concat('ocr ', CAST(vec_id AS VARCHAR)) END AS ocr,
    CASE vec_id % 3
      WHEN 0 THEN [concat(CAST(vec_id % {NU} AS VARCHAR), '_S0_E', CAST(vec_id % 40 + 5 AS VARCHAR))]
      WHEN 1 THEN [concat(CAST(vec_id % {NU} AS VARCHAR), '_S0_E', CAST(vec_id % 40 + 5 AS VARCHAR)),
                   concat(CAST((vec_id + 7) % {NU} AS VARCHAR), '_S', CAST(vec_id % 30 AS VARCHAR),
                          '_E', CAST(vec_id % 30 + 20 AS VARCHAR))]
      ELSE [concat(CAST(vec_id % {NU} AS VARCHAR), '_S0_E', CAST(vec_id % 40 + 5 AS VARCHAR)),
            concat(CAST((vec_id + 7) % {NU} AS VARCHAR), '_S', CAST(vec_id % 30 AS VARCHAR),
                   '_E', CAST(vec_id % 30 + 20 AS VARCHAR)),
            concat(CAST((vec_id + 13) % {NU} AS VARCHAR), '_S', CAST(vec_id % 50 + 10 AS VARCHAR),
                   '_E', CAST(vec_id % 50 + 60 AS VARCHAR))] END AS visual_materials,
    label, source
  FROM fx_items)"""


NL = "(SELECT count(DISTINCT label) FROM embeddings)"

#: fx_items with ``fea`` replaced by the fused vector of the assembled modalities.
FX_FUSED_SQL = FX_ITEMS_SQL.replace("fx_items AS", "fx_plain AS", 1) + f""",
wide AS (
  SELECT CAST(label AS VARCHAR) AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
    CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
wide_n AS (SELECT key, count(*) AS n FROM wide GROUP BY key),
wclips AS (
  SELECT video_id, 0 AS mp, CAST(vec_id % {NL} AS VARCHAR) AS src, vec_id % 5 AS s, vec_id % 5 + 3 AS e FROM fx_plain
  UNION ALL SELECT video_id, 1, CAST((vec_id + 3) % {NL} AS VARCHAR), 0, vec_id % 90 FROM fx_plain WHERE vec_id % 3 = 1),
wlens AS (SELECT c.*, greatest(0, least(n, e + 1) - least(n, s)) AS len FROM wclips c JOIN wide_n ON key = src),
woffs AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY video_id ORDER BY mp ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND 1 PRECEDING), 0) AS off FROM wlens),
wseq AS (SELECT video_id, 'frames' AS m, off + pos - s AS pos, vec FROM woffs JOIN wide ON key = src AND pos BETWEEN s AND e
  UNION ALL SELECT video_id, 'audio', pos, vec FROM fx_plain JOIN wide ON key = CAST(vec_id % {NL} AS VARCHAR)
  UNION ALL SELECT video_id, 'text', 0, fea FROM fx_plain
  UNION ALL SELECT i.video_id, 'motion', 0, k.fea FROM fx_plain i JOIN fx_plain k ON k.video_id =
    CASE WHEN contains(i.video_id, 'TMVO') THEN split_part(i.video_id, '_', 1) ELSE i.video_id END),
wlong AS (SELECT m, video_id, count(*) OVER (PARTITION BY m, video_id) AS n, pos, vec,
    CASE m WHEN 'frames' THEN 83 WHEN 'motion' THEN 83 WHEN 'audio' THEN 50 END AS want FROM wseq),
wkept AS (SELECT *, coalesce(want, n) AS rows FROM wlong
  WHERE want IS NULL OR pos % greatest(n // want, 1) = 0 AND pos // greatest(n // want, 1) < want),
wdims AS (SELECT video_id, m, rows, unnest(vec) AS v, unnest(generate_series(1, len(vec))) AS d FROM wkept),
wmeans AS (SELECT video_id, m, d, sum(v) / any_value(rows) AS mean FROM wdims GROUP BY video_id, m, d),
wfused AS (SELECT video_id, d, sum(mean) / 4 AS x FROM wmeans GROUP BY video_id, d),
wvec AS (SELECT video_id, list(x ORDER BY d) AS fused FROM wfused GROUP BY video_id),
fx_items AS (
  SELECT vec_id, video_id, source, label, split, fused AS fea FROM fx_plain JOIN wvec USING (video_id))"""
