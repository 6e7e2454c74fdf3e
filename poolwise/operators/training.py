"""Model fitting and scoring.

The reference trains a neural backbone per round; here the backbone is a
nearest-centroid head over the fused item vector: per class the mean vector,
logits ``scale * <x, centroid_c>``. A model is stored as per-class *sums and
counts*, so "retrain on train ∪ selected" is old sums + sums of the selected
rows (only the new rows are scanned), and k-fold models come from one
aggregation: fold f's model = all training sums − fold f's own sums.
Spark ML logistic regression is offered as the second head (same
softmax-linear classifier + cross-entropy as the reference's output layer).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import argmax, dot, entropy, softmax

DEFAULT_SCALE = 10.0
CLASSES = (0, 1)


def class_sums(df: DataFrame, by: Sequence[str] = (), y: str = "y", vec: str = "fea") -> DataFrame:
    """by…, y, n, vsum (element-wise sum). Spark ML's vector ``Summarizer``
    aggregates whole vectors in a partial (map-side) + final object hash
    aggregate: one buffer per group, no per-dimension explode."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    by = list(by)
    summ = Summarizer.metrics("sum", "count")
    agg = df.groupBy(*by, y).agg(summ.summary(array_to_vector(F.col(vec).cast("array<double>"))).alias("_s"))
    return agg.select(*by, y, F.col("_s.count").cast("long").alias("n"),
                      vector_to_array(F.col("_s.sum")).alias("vsum"))


def add_sums(a: DataFrame, b: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Model update: element-wise sums and counts of two sum tables."""
    keys = list(by) + [y]
    j = a.alias("a").join(b.alias("b"), keys, "full_outer")
    return j.select(*keys,
                    (F.coalesce(F.col("a.n"), F.lit(0)) + F.coalesce(F.col("b.n"), F.lit(0))).alias("n"),
                    F.when(F.col("a.vsum").isNull(), F.col("b.vsum"))
                    .when(F.col("b.vsum").isNull(), F.col("a.vsum"))
                    .otherwise(F.zip_with("a.vsum", "b.vsum", lambda u, v: u + v)).alias("vsum"))


def centroids_from_sums(sums: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """by…, y, n, centroid."""
    return sums.select(*by, y, "n", F.transform("vsum", lambda v: v / F.col("n")).alias("centroid"))


def fit_centroids(train: DataFrame, by: Sequence[str] = (), y: str = "y", vec: str = "fea") -> DataFrame:
    return centroids_from_sums(class_sums(train, by, y, vec), by, y)


def kfold_sums(train: DataFrame, k: int, fold_col: str = "fold", y: str = "y",
               vec: str = "fea") -> DataFrame:
    """Per run fold f, the class sums over the training ids *not* in fold f,
    from a single aggregation of per-fold sums (k-fold trick)."""
    per = class_sums(train, [fold_col], y, vec)
    runs = per.withColumn("run_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
        .filter(F.col("run_fold") != F.col(fold_col))
    exploded = runs.select("run_fold", y, "n", F.posexplode("vsum").alias("_d", "_v"))
    agg = exploded.groupBy("run_fold", y, "_d").agg(F.sum("_v").alias("_s"))
    ns = runs.groupBy("run_fold", y).agg(F.sum("n").alias("n"))
    vs = (agg.groupBy("run_fold", y)
          .agg(F.array_sort(F.collect_list(F.struct("_d", "_s"))).alias("_ds"))
          .select("run_fold", y, F.transform("_ds", lambda s: s["_s"]).alias("vsum")))
    return ns.join(vs, ["run_fold", y]).withColumnRenamed("run_fold", fold_col)


def model_wide(model: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """One row per model (by…): c0, c1 centroid columns."""
    by = list(by)
    cols = [F.max(F.when(F.col(y) == c, F.col("centroid"))).alias(f"c{c}") for c in CLASSES]
    if not by:
        return model.agg(*cols).withColumn("_one", F.lit(1))
    return model.groupBy(*by).agg(*cols)


def score_centroids(model: DataFrame, df: DataFrame, by: Sequence[str] = (),
                    vec: str = "fea", y: str = "y", scale: float = DEFAULT_SCALE) -> DataFrame:
    """Adds ``logits``, ``probs``, ``entropy``, ``pred`` to ``df``.

    The model table has folds × classes rows whatever the data size, so it
    is broadcast. A class without training rows scores logit 0."""
    by = list(by)
    wide = model_wide(model, by, y)
    if by:
        j = df.join(F.broadcast(wide), by, "left")
    else:
        j = df.withColumn("_one", F.lit(1)).join(F.broadcast(wide), "_one", "left").drop("_one")
    j = j.withColumn("_x", F.col(vec).cast("array<double>"))
    logit = lambda c: F.coalesce(F.lit(scale) * dot("_x", c), F.lit(0.0))
    out = j.withColumn("logits", F.array(logit("c0"), logit("c1"))).drop("c0", "c1", "_x")
    return with_prediction(out)


def with_prediction(df: DataFrame, logits: str = "logits") -> DataFrame:
    probs = softmax(logits)
    return (df.withColumn("probs", probs)
            .withColumn("entropy", entropy("probs"))
            .withColumn("pred", argmax(logits)))


def linear_scores(df: DataFrame, weights: DataFrame, vec: str = "fea", relu_input: bool = False) -> DataFrame:
    """Classifier head ``W x + b``: ``weights`` has one row per class
    (``cls INT, w ARRAY<DOUBLE>, b DOUBLE``); a handful of rows, broadcast.
    Adds ``logits`` ordered by class."""
    from ..functions.vectors import relu
    wa = weights.agg(F.array_sort(F.collect_list(F.struct("cls", "w", "b"))).alias("_w")) \
        .withColumn("_one", F.lit(1))
    x = F.col(vec).cast("array<double>")
    if relu_input:
        x = relu(x)
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(wa), "_one").drop("_one")
    return j.withColumn("logits", F.transform("_w", lambda r: dot(x, r["w"]) + r["b"])).drop("_w")


def fit_logreg(train: DataFrame, vec: str = "fea", y: str = "y", max_iter: int = 200, reg: float = 0.01,
               tol: float = 1e-6):
    """Spark ML multinomial logistic regression on the fused vector with an L2
    penalty (without one, separable data have no optimum); returns the fitted
    model (``model.transform`` scores a DataFrame). Raises if the optimiser
    stops at ``max_iter`` without having converged."""
    if reg <= 0:
        raise ValueError("reg must be positive")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = train.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
                        F.col(y).cast("double").alias("label"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                            regParam=reg, family="multinomial", standardization=False, tol=tol)
    model = lr.fit(data)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"not converged in {max_iter} iterations")
    return model


def logreg_gradient(model, df: DataFrame, vec: str = "fea", y: str = "y", reg: float = 0.01) -> DataFrame:
    """cls, d, gradient of the mean penalised log loss at the fitted point
    (dimension ``len(vec)`` is the intercept, which has no penalty): zero at
    the optimum. One grouped sum of whole vectors per class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    spark = df.sparkSession
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    heads = spark.createDataFrame([(c, [float(v) for v in w[c]], float(b[c])) for c in range(len(b))], "cls int, w array<double>, b double")
    scored = linear_scores(df.select(F.col(vec).cast("array<double>").alias("_x"), y), heads, "_x")
    slope = F.transform(softmax("logits"), lambda p, c: p - F.when(F.col(y) == c, 1.0).otherwise(0.0))
    each = scored.select(F.concat("_x", F.array(F.lit(1.0))).alias("_x1"), F.posexplode(slope).alias("cls", "_s"))
    each = each.select("cls", array_to_vector(F.transform("_x1", lambda v: v * F.col("_s"))).alias("_g"))
    g = each.groupBy("cls").agg(Summarizer.mean(F.col("_g")).alias("_m"))  # one row a class
    g = g.select("cls", F.posexplode(vector_to_array("_m")).alias("d", "_v")).join(heads, "cls")
    return g.select("cls", "d", (F.col("_v") + F.when(F.col("d") < F.size("w"), reg * F.get("w", F.col("d"))).otherwise(0.0)).alias("gradient"))


def logreg_scores(model, df: DataFrame, vec: str = "fea") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))))
    return with_prediction(scored.withColumn("logits", vector_to_array("rawPrediction"))
                           .drop("features", "rawPrediction", "probability", "prediction"))


def early_stop(history: DataFrame, patience: int = 5, threshold: float = 0.6,
               run: str = "run_id", epoch: str = "epoch", f1: str = "f1") -> DataFrame:
    """Early-stopping analysis of a metric history (epochs 1-based).

    Running best with strict ``>`` from 0.0; stop at the first epoch that does
    not improve and lies ``patience`` or more epochs after the best one; a
    model is saved (``is_final``) only if the best exceeds ``threshold``.
    Per run: stop_epoch (last epoch if it never stops), best_epoch, best_f1,
    is_final, epochs_run. Windows are per run (bounded by the epoch count)."""
    w_prev = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_cur = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    h = history.withColumn("_prev", F.coalesce(F.max(f1).over(w_prev), F.lit(0.0)))
    h = h.withColumn("_imp", F.col(f1) > F.col("_prev"))
    h = h.withColumn("_best_ep", F.coalesce(F.max(F.when(F.col("_imp"), F.col(epoch))).over(w_cur), F.lit(0)))
    h = h.withColumn("_best_f1", F.greatest(F.col("_prev"), F.col(f1)))
    h = h.withColumn("_stop", (~F.col("_imp")) & (F.col(epoch) - F.col("_best_ep") >= patience))
    stop = h.groupBy(run).agg(F.min(F.when(F.col("_stop"), F.col(epoch))).alias("_se"),
                              F.max(epoch).alias("_last"))
    hs = h.join(stop, run).withColumn("stop_epoch", F.coalesce("_se", "_last"))
    at_stop = hs.filter(F.col(epoch) == F.col("stop_epoch"))
    return at_stop.select(
        run, F.col("stop_epoch").cast("long").alias("stop_epoch"),
        F.col("_best_ep").cast("long").alias("best_epoch"),
        F.col("_best_f1").alias("best_f1"),
        (F.col("_best_f1") > F.lit(threshold)).alias("is_final"),
        F.col("_se").isNotNull().alias("stopped"))


class CentroidArrayModel:
    """A model object for :func:`score_with`: numpy centroids, same logits as
    :func:`score_centroids`. Any object with ``predict(x) -> logits`` works
    the same way (a user's network, a linear head, …)."""

    def __init__(self, centroids, scale: float = DEFAULT_SCALE):
        import numpy as np
        self.c = np.asarray(centroids, dtype=np.float64)  # classes x d
        self.scale = scale

    def predict(self, x):
        return self.scale * (x @ self.c.T)


def shipped(spark, model, max_model_bytes: int):
    """A Python model with its class definition as a broadcast of checked
    size (executors need not import the module that defines it)."""
    import sys
    from pyspark import cloudpickle
    mod = sys.modules.get(type(model).__module__)
    if mod is not None and type(model).__module__ not in ("builtins", "__main__"):
        cloudpickle.register_pickle_by_value(mod)
    data = cloudpickle.dumps(model)
    if len(data) > max_model_bytes:
        raise ValueError(f"the model has {len(data)} bytes; the bound is {max_model_bytes}")
    return spark.sparkContext.broadcast(data)


def _load(data: bytes):
    """The shipped model, unpickled once per worker."""
    import hashlib
    from pyspark import cloudpickle
    key = hashlib.sha1(data).digest()
    if _LOADED.get("key") != key:
        _LOADED.update(key=key, model=cloudpickle.loads(data))
    return _LOADED["model"]


_LOADED: dict = {}


def map_vectors(df: DataFrame, project, vec: str = "fea", max_model_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with ``vec`` replaced by ``project(rows)``, a Python function of
    a numpy matrix applied to whole Arrow batches."""
    import numpy as np
    from pyspark.sql import types as T
    bc = shipped(df.sparkSession, project, max_model_bytes)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == vec else f for f in df.schema])

    def run(batches):
        f = _load(bc.value)
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec].values])
                pdf[vec] = list(np.asarray(f(x), dtype=np.float64))
            yield pdf
    return df.withColumn(vec, F.col(vec).cast("array<double>")).mapInPandas(run, schema)


def score_with(df: DataFrame, model, vec: str = "fea", keep: Sequence[str] | None = None,
               max_model_bytes: int = 64 << 20) -> DataFrame:
    """Score ``df`` with a Python model shipped once per executor (broadcast of
    checked size) and applied to whole Arrow batches (``mapInPandas``,
    vectorised numpy — never row at a time). ``model.predict(x)`` gives the
    logits, or (logits, vectors). Adds ``logits``, ``out`` (the vectors; the
    input where the model gives none) and ``probs``/``entropy``/``pred``."""
    import numpy as np
    from pyspark.sql import types as T
    keep = list(keep) if keep is not None else [c for c in df.columns if c != vec]
    bc = shipped(df.sparkSession, model, max_model_bytes)
    schema = T.StructType([df.schema[c] for c in keep]
                          + [T.StructField(c, T.ArrayType(T.DoubleType()), True) for c in ("logits", "out")])

    def run(batches):
        m = _load(bc.value)
        for pdf in batches:
            result = pdf[keep].copy()
            if not len(pdf):
                result["logits"], result["out"] = [], []
            else:
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec].values])
                got = m.predict(x)
                logits, out = got if isinstance(got, tuple) else (got, x)
                result["logits"] = list(np.asarray(logits, dtype=np.float64))
                result["out"] = list(np.asarray(out, dtype=np.float64))
            yield result
    return with_prediction(df.select(*keep, F.col(vec).cast("array<double>").alias(vec)).mapInPandas(run, schema))
