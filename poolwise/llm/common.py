"""Helpers shared by the operators: tables in the shared folder and the text
conventions that several operators have in common."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: A-Z only; Spark's ``lower`` would also fold other scripts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read
    back: lineage is cut, a lost executor rereads files, and the planner
    knows the real size of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads
    any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_row_key(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Tag rows so that repeated rows stay apart. The key is only stable once
    the tagged table is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def python_values(array: pa.Array) -> list:
    """The texts or bytes of an Arrow array as ``to_pylist`` gives them, without
    an Arrow scalar for each."""
    return array.to_numpy(zero_copy_only=False).tolist()


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Python tasks planned inside get Arrow batches of at most ``most`` rows;
    a batch of whole texts is held by the executor's JVM and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` for working columns beside all columns of ``df``, each with
    underscores in front until no column has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sample_of_texts(df: DataFrame, order: Column, max_bytes: int, by: str | None = None) -> list[Row]:
    """The rows of a sample (with ``text``; its number of rows is bounded by
    the caller) that reach the driver, of ``max_bytes`` altogether, shared
    evenly by the values of ``by``. Texts are whole or not there: those of more
    than a 64th of their group's bytes come after the others, the shorter first,
    and fill what these leave. The result is in ``order``. Every group with rows
    has rows in the sample (its first row, whatever its size)."""
    rows = written(with_row_key(df.withColumn("_order", order)), "text-sample")
    if by:
        max_bytes //= max(1, rows.select(by).distinct().count())
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    narrow = rows.select("_rid", "_order", F.col(by).alias("_by") if by else F.lit(0).alias("_by"), size.alias("_size"))
    late = F.when(F.col("_size") > max(1, max_bytes // 64), F.col("_size")).otherwise(0)
    first = Window.partitionBy("_by").orderBy(late, "_order", "_rid")  # a row per sampled text
    fits = narrow.withColumn("_upto", F.sum("_size").over(first)).withColumn("_n", F.row_number().over(first)) \
        .filter((F.col("_upto") <= max_bytes) | (F.col("_n") == 1)).select("_rid")
    got = rows.join(fits, "_rid").collect()
    return sorted(got, key=lambda r: (r["_order"], r["_rid"]))
