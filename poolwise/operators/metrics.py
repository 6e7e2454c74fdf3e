"""Classification metrics as one grouped aggregation each.

Every metric is derived from four conditional counts per group
(``c00 c01 c10 c11`` = truth/prediction cells), so a metric over billions of
rows is one partial + final hash aggregate and never collects labels.
Semantics follow the scikit-learn calls of the reference: macro averages over
the classes present in truth or prediction, 0 where a denominator is 0, and
F1 per class = ``2tp / (2tp + fp + fn)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import totals_before

# --- fixed values: class names of the report, in label order ---------------
CLASS_NAMES = ["real", "fake"]
# ---------------------------------------------------------------------------


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def confusion_counts(df: DataFrame, y: str = "y", p: str = "p",
                     keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """The four cells of labels 0 and 1. ``strict``: any other value raises."""
    yc, pc = F.col(y), F.col(p)
    if strict:
        known = lambda c: F.when(c.isin(0, 1), c).otherwise(
            F.raise_error(F.concat(F.lit("not a binary label: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int"))
        yc, pc = known(yc), known(pc)
    return df.groupBy(*keys).agg(
        _cnt((yc == 0) & (pc == 0)).alias("c00"), _cnt((yc == 0) & (pc == 1)).alias("c01"),
        _cnt((yc == 1) & (pc == 0)).alias("c10"), _cnt((yc == 1) & (pc == 1)).alias("c11"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def metrics_from_counts(c00="c00", c01="c01", c10="c10", c11="c11") -> dict[str, Column]:
    c00, c01, c10, c11 = (F.col(c) for c in (c00, c01, c10, c11))
    n = c00 + c01 + c10 + c11
    present0 = (c00 + c01 + c10) > 0
    present1 = (c11 + c01 + c10) > 0
    n_cls = present0.cast("int") + present1.cast("int")
    prec0, prec1 = _div(c00, c00 + c10), _div(c11, c11 + c01)
    rec0, rec1 = _div(c00, c00 + c01), _div(c11, c11 + c10)
    f10 = _div(2 * c00, 2 * c00 + c10 + c01)
    f11 = _div(2 * c11, 2 * c11 + c01 + c10)

    def macro(a: Column, b: Column) -> Column:
        both = (a + b) / F.lit(2.0)
        return (F.when(present0 & present1, both).when(present0, a).when(present1, b))

    has_both_truths = ((c00 + c01) > 0) & ((c10 + c11) > 0)
    return {
        "n": n,
        "acc": _div(c00 + c11, n),
        "precision": macro(prec0, prec1),
        "recall": macro(rec0, rec1),
        "f1": macro(f10, f11),
        # AUC of hard 0/1 predictions = mean of the two recalls; undefined
        # (NULL) when the truth has a single class
        "auc": F.when(has_both_truths, (rec0 + rec1) / F.lit(2.0)),
        "_n_classes": n_cls,
    }


def class_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """keys…, n, acc, precision, recall, f1 for any number of classes: macro
    averages over the classes seen in truth or prediction; every row counts.
    Rows are reduced to (truth, prediction) cells first."""
    keys = list(keys)
    cells = df.groupBy(*keys, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    sides = cells.select(*keys, "_n", hit.alias("_hit"), F.explode(F.array(
        F.struct(F.col("_y").cast("long").alias("c"), F.lit(1).alias("t")),
        F.struct(F.col("_p").cast("long").alias("c"), F.lit(0).alias("t")))).alias("_s"))
    per = sides.groupBy(*keys, F.col("_s.c").alias("_c")).agg(
        F.sum(F.when(F.col("_s.t") == 1, F.col("_n")).otherwise(0)).alias("_true"),
        F.sum(F.when(F.col("_s.t") == 0, F.col("_n")).otherwise(0)).alias("_pred"),
        F.sum(F.when(F.col("_s.t") == 1, F.col("_hit")).otherwise(0)).alias("_tp"))
    out = per.groupBy(*keys).agg(
        F.sum("_true").cast("long").alias("n"), _div(F.sum("_tp"), F.sum("_true")).alias("acc"),
        F.avg(_div(F.col("_tp"), F.col("_pred"))).alias("precision"),
        F.avg(_div(F.col("_tp"), F.col("_true"))).alias("recall"),
        F.avg(_div(2 * F.col("_tp"), F.col("_true") + F.col("_pred"))).alias("f1"))
    if not keys:  # an aggregate without keys has a row even for no input
        out = out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("acc", F.coalesce("acc", F.lit(0.0)))
    return out


def auc_of_levels(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, auc: Mann-Whitney AUC with ties counted half. Rows are reduced to
    one per score level first (a score that most rows share costs one row), and
    the negatives below a level come from two-level running totals. NULL when
    the truth is not of both kinds."""
    keys = list(keys)
    levels = df.groupBy(*keys, F.col(score).alias("_score")).agg(
        _cnt(F.col(y) == 1).alias("_pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("_neg"))
    below = totals_before(levels, [F.col("_score").asc_nulls_first()], ["_neg"], by=keys)
    wins = F.sum(F.col("_pos") * (F.col("before__neg") + F.col("_neg") / F.lit(2.0)))
    P, N = F.sum("_pos"), F.sum("_neg")
    return below.groupBy(*keys).agg(F.when((P > 0) & (N > 0), wins / (P * N)).alias("auc"))


def _beside(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two metric tables of one row per ``keys`` (null keys match)."""
    if not keys:  # single rows on both sides: join on a constant key
        return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    right = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return a.join(right, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p",
                   keys: Sequence[str] = ()) -> DataFrame:
    """keys…, n, acc, precision, recall, f1, auc of hard 0/1 predictions from
    four counts per group. For more classes use :func:`class_metrics`; a row
    that is neither 0 nor 1 raises here, so that none is lost."""
    counts = confusion_counts(df, y, p, keys, strict=True)
    m = metrics_from_counts()
    return counts.select(*keys, m["n"].alias("n"), m["acc"].alias("acc"),
                         m["precision"].alias("precision"), m["recall"].alias("recall"),
                         m["f1"].alias("f1"), m["auc"].alias("auc"))


def auc_scores(df: DataFrame, y: str = "y", score: str = "score",
               keys: Sequence[str] = ()) -> DataFrame:
    """ROC AUC of continuous scores with ties counted half, followed by the
    hard metrics of the half-to-even rounded score, as the reference's
    metric function does (AUC before rounding). keys…, n, acc, …, auc. A score
    that rounds to a third class counts as one (:func:`class_metrics`)."""
    keys = list(keys)
    src = df.select(*keys, score, y)
    hard = class_metrics(src.withColumn("_hard", F.bround(F.col(score), 0).cast("int")), y, "_hard", keys)
    return _beside(hard, auc_of_levels(src, y, score, keys), keys)


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "p",
                     keys: Sequence[str] = ()) -> DataFrame:
    """keys…, y, p, n for the four cells of labels [0, 1]; empty cells kept. A
    row that is neither 0 nor 1 raises, so that none is lost. Built by unpivoting the four counts, so no grid join is needed."""
    c = confusion_counts(df, y, p, keys, strict=True)
    return c.select(*keys, F.expr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (y, p, n)"))


def classification_report(df: DataFrame, y: str = "y", p: str = "p",
                          keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Per class precision / recall / F1 / support for labels [0, 1] with
    names real / fake, then accuracy, macro avg, weighted avg rows, rounded
    to ``digits``. Columns: keys…, label, precision, recall, f1, support.

    Every row counts, whatever its truth or prediction: a third class lowers
    the precision or recall it takes part in and the accuracy (of all rows).
    If there are such rows, a row ``outside`` says how many."""
    yc, pc = F.col(y), F.col(p)
    known = yc.eqNullSafe(F.lit(0)) | yc.eqNullSafe(F.lit(1))
    other = ~known | ~(pc.eqNullSafe(F.lit(0)) | pc.eqNullSafe(F.lit(1)))
    c = df.groupBy(*keys).agg(
        *[_cnt(yc.eqNullSafe(F.lit(k)) & pc.eqNullSafe(F.lit(k))).alias(f"c{k}{k}") for k in (0, 1)],
        *[_cnt(yc.eqNullSafe(F.lit(k))).alias(f"s{k}") for k in (0, 1)], *[_cnt(pc.eqNullSafe(F.lit(k))).alias(f"p{k}") for k in (0, 1)],
        _cnt(yc.eqNullSafe(pc) & yc.isNotNull()).alias("hits"), _cnt(other).alias("outside"), F.count(F.lit(1)).alias("rows"))
    c00, c11, s0, s1, n = (F.col(x) for x in ("c00", "c11", "s0", "s1", "rows"))
    prec0, prec1 = _div(c00, F.col("p0")), _div(c11, F.col("p1"))
    rec0, rec1 = _div(c00, s0), _div(c11, s1)
    f0 = _div(2 * c00, s0 + F.col("p0"))
    f1 = _div(2 * c11, s1 + F.col("p1"))
    r = lambda v: F.round(v, digits)
    nul = F.lit(None).cast("double")
    row = lambda name, pr, rc, f, s: F.struct(F.lit(name).alias("label"), r(pr).alias("precision"),
                                              r(rc).alias("recall"), r(f).alias("f1"),
                                              s.cast("long").alias("support"))
    rows = F.array(
        row(CLASS_NAMES[0], prec0, rec0, f0, s0),
        row(CLASS_NAMES[1], prec1, rec1, f1, s1),
        row("accuracy", nul, nul, _div(F.col("hits"), n), n),
        row("macro avg", (prec0 + prec1) / 2, (rec0 + rec1) / 2, (f0 + f1) / 2, s0 + s1),
        row("weighted avg", _div(prec0 * s0 + prec1 * s1, s0 + s1), _div(rec0 * s0 + rec1 * s1, s0 + s1),
            _div(f0 * s0 + f1 * s1, s0 + s1), s0 + s1),
        row("outside", nul, nul, nul, F.col("outside")),
    )
    return c.select(*keys, F.inline(rows)).filter((F.col("label") != "outside") | (F.col("support") > 0))


def logsumexp(logits) -> Column:
    l = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(l)
    s = F.aggregate(l, F.lit(0.0).cast("double"), lambda acc, v: acc + F.exp(v - m))
    return m + F.log(s)


def mean_log_loss(df: DataFrame, logits: str = "logits", y: str = "y",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy ``logsumexp(l) - l[y]`` (the reference's batch means
    re-weighted by batch size are the plain mean over rows)."""
    loss = logsumexp(logits) - F.element_at(F.col(logits), F.col(y) + 1)
    return df.groupBy(*keys).agg(F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("n"))
