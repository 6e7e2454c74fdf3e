"""Plain one-task forms of skew-safe operators, for parity checks."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from poolwise.functions.vectors import cosine


def window_rank(df, order, by=(), name="rank"):
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def shot_segments_window(seq, threshold, key="key", pos="pos", vec="vec"):
    w = Window.partitionBy(key).orderBy(pos)
    s = seq.withColumn("_prev", F.lag(F.col(vec)).over(w))
    cut = F.when(F.col("_prev").isNull() | (cosine(F.col(vec), F.col("_prev")) < F.lit(threshold)), F.lit(1)).otherwise(F.lit(0))
    s = s.withColumn("_cut", cut)
    s = s.withColumn("segment", (F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    g = s.groupBy(key, "segment").agg(F.min(pos).alias("start_pos"), F.max(pos).alias("end_pos"),
                                      F.count(F.lit(1)).alias("n_frames"))
    return g.withColumn("clip", F.concat(F.col(key).cast("string"), F.lit("_S"), F.col("start_pos").cast("string"),
                                         F.lit("_E"), F.col("end_pos").cast("string")))
