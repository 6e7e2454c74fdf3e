"""A learned quality gate (K7): items without a label are decided, too.

Texts become hashed counts of words and of the shapes of words (Spark ML
``HashingTF``, no vocabulary to collect) and a logistic regression learns the
labelled quality from all labelled rows but a hashed fifth, which then sets the
threshold: scores are reduced to a histogram of at most ``LEVELS`` bins, and the
cut with the best F1 is taken. A labelled row keeps its label; the model decides
the others. Everything but the histogram and the coefficients (a bounded number
of each) stays on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features of a text.
FEATURES = 1 << 13
#: Bins of the score histogram.
LEVELS = 1000


@dataclass
class Gate:
    model: object      # a fitted logistic regression
    threshold: float
    f1: float          # on the rows that set the threshold
    n_held: int


def quality_label(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, good: 1 where some label row says quality 1 and not toxic. Rows
    without an id or without both labels say nothing."""
    ok = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(id_col).agg(F.max(ok.cast("int")).alias("good"))


def held(id_col: str) -> Column:
    """The fifth of the labelled rows that sets the threshold."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 1


def with_features(items: DataFrame, text: str = "text", out: str = "_features") -> DataFrame:
    """``items`` with hashed counts: words, and their shapes (letters as ``a``,
    digits as ``0``, runs shortened), which tell prose from tables and junk."""
    from pyspark.ml.feature import HashingTF
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    shape = lambda w: F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(F.regexp_replace(
        w, r"\p{L}+", "a"), r"\d+", "0"), r"([^a0])\1+", "$1"))
    terms = items.withColumn("_terms", F.concat(words, F.transform(words, shape)))
    counted = HashingTF(numFeatures=FEATURES, inputCol="_terms", outputCol="_counts").transform(terms).drop("_terms")
    from pyspark.ml.feature import Normalizer
    return Normalizer(inputCol="_counts", outputCol=out, p=2.0).transform(counted).drop("_counts")


def best_cut(scores: DataFrame, score: str = "score", good: str = "good") -> tuple[float, float, int]:
    """(threshold, F1, rows): the lowest cut of best F1 over a histogram of the
    scores, kept if at or above the threshold."""
    bin_ = F.least(F.floor(F.col(score) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    rows = scores.groupBy(bin_.alias("b")).agg(F.sum(good).alias("pos"), F.count(F.lit(1)).alias("n")).collect()  # at most LEVELS rows
    total, n_all = sum(r.pos for r in rows), sum(r.n for r in rows)
    best, pos, n = (0.5, -1.0), 0, 0
    for r in sorted(rows, key=lambda r: -r.b):
        pos, n = pos + r.pos, n + r.n
        f1 = 2 * pos / (n + total)
        if f1 >= best[1]:
            best = (r.b / LEVELS, f1)
    return best[0], max(best[1], 0.0), n_all


def score(items: DataFrame, gate_model, text: str = "text") -> DataFrame:
    """``items`` with the model's ``score`` (0 to 1)."""
    out = gate_model.transform(with_features(items, text))
    return out.withColumn("score", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def fit_gate(items: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", reg: float = 1e-4, max_iter: int = 60) -> Gate:
    """Learn from all labelled rows of ``items``. Needs labels of both kinds in
    both parts."""
    from pyspark.ml.classification import LogisticRegression
    from ..session import cut_lineage, release
    known = items.select(id_col, text).join(quality_label(labels, id_col), id_col)
    rows = cut_lineage(with_features(known, text).select(id_col, "good", held(id_col).alias("held"), "_features"))
    kinds = {(r.held, r.good) for r in rows.groupBy("held", "good").count().collect()}
    if len(kinds) < 4:
        raise ValueError("the labelled rows don't hold both qualities in both parts")
    fit = LogisticRegression(featuresCol="_features", labelCol="good", rawPredictionCol="_raw", probabilityCol="_probability",
                             predictionCol="_prediction", regParam=reg, maxIter=max_iter, standardization=False).fit(rows.filter(~F.col("held")))
    scored = fit.transform(rows.filter("held")).select("good", vector_to_array("_probability")[1].alias("score"))
    threshold, f1, n = best_cut(scored)
    release(rows)
    return Gate(fit, threshold, f1, n)


def learned_gate(items: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", gate: Gate | None = None) -> DataFrame:
    """One row per row of ``items``: id, score, decided_by (``label`` or
    ``model``), kept. A null text has no features and the model's base rate."""
    gate = gate or fit_gate(items, labels, id_col, text)
    known = quality_label(labels, id_col).withColumnRenamed(id_col, "_known")
    rows = score(items.select(id_col, text), gate.model, text).select(id_col, "score")
    out = rows.join(known, F.col(id_col) == F.col("_known"), "left")
    return out.select(id_col, "score", F.when(F.col("good").isNull(), "model").otherwise("label").alias("decided_by"),
                      F.coalesce(F.col("good") == 1, F.col("score") >= gate.threshold).alias("kept"))
