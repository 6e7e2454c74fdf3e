"""Session helpers: building a local session for tests/bench and finding the
shared scratch folder a cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "poolwise") -> SparkSession:
    """A ``local[N]`` session for tests and the bench. On a cluster the caller
    builds its own session; nothing here is needed there."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. A cluster names a shared folder
    in ``spark.checkpoint.dir``; that setting always wins. Only a local session
    (one machine) without the setting gets a private folder; anywhere else
    a missing setting is an error, as executors would not see each other's
    files."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="poolwise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for tables that cut
    lineage or round-trip through a sink."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/poolwise/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


#: Scratch paths made inside each open :func:`scratch_scope`, outermost first.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes, at its end, every scratch table made inside it (also after an
    error), but those given to the function it yields: ``keep(df)`` hands the
    tables that ``df`` reads on to the scope around it. Results must be written
    inside the scope, as lazy plans over removed tables can't run."""
    made: list[str] = []
    _SCOPES.append(made)

    def keep(*frames):
        for df in frames:
            files = df if isinstance(df, list) else df.inputFiles()
            for path in [p for p in made if any(f"{p.split('://')[-1].split(':')[-1]}/" in f"{f}/" for f in files)]:
                made.remove(path)
                if len(_SCOPES) > 1:
                    _SCOPES[_SCOPES.index(made) - 1].append(path)

    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more, in whatever store
    it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def local_rows(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A few rows of the driver as a table that is part of the plan. (From a
    list of tuples Spark makes a Python stage with a task for every core.)"""
    import pyarrow as pa

    if not all(isinstance(f.dataType, AtomicType) for f in schema.fields):
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows]) for i in range(len(schema))], names=schema.names), schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table under the checkpoint folder and read
    back (survives the loss of executors, unlike ``persist``; a
    ``Dataset.checkpoint`` would compute its input twice)."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the table behind a :func:`cut_lineage` result that nothing reads
    any more."""
    for file in df.inputFiles()[:1]:
        remove_path(df.sparkSession, file.rsplit("/", 1)[0])


class FoldTables:
    """A table with a ``fold`` column kept as one folder a fold. Replacing some
    folds writes these and refers to the folders of the others, so a round
    copies nothing that it leaves as it was."""

    def __init__(self, spark: SparkSession, schema, paths: dict[int, str]):
        self.spark, self.schema, self.paths = spark, schema, paths

    @classmethod
    def write(cls, df: DataFrame, name: str = "folds") -> "FoldTables":
        spark = df.sparkSession
        root = scratch_path(spark, name)
        df.withColumn("_folder", F.col("fold")).write.partitionBy("_folder").parquet(root)
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(x.getPath()) for x in store.listStatus(target) if x.isDirectory()]
        return cls(spark, df.schema, {int(p.rsplit("_folder=", 1)[1]): p for p in found if "_folder=" in p})

    def frame(self, folds=None) -> DataFrame:
        """The rows of ``folds`` (default: all)."""
        paths = [p for f, p in sorted(self.paths.items()) if folds is None or f in folds]
        if not paths:
            return local_rows(self.spark, [], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replaced(self, other: "FoldTables", folds) -> "FoldTables":
        """This table with ``folds`` as they are in ``other`` (a fold without
        rows there has none)."""
        kept = {f: p for f, p in self.paths.items() if f not in folds}
        return FoldTables(self.spark, self.schema, {**kept, **{f: p for f, p in other.paths.items() if f in folds}})

    def release(self, *still_used: "FoldTables") -> None:
        """Remove the folders that none of ``still_used`` refers to."""
        used = {p for t in still_used if t is not None for p in t.paths.values()}
        for path in self.paths.values():
            if path not in used:
                remove_path(self.spark, path)


def recommended_conf(input_bytes: int, executors: int, cores_per_executor: int,
                     target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings to size a cluster run from the input size (a starting point;
    AQE coalesces and splits at run time). Shuffle partitions give ~128 MB
    per partition and at least 2 waves of tasks; skewed partitions above 4x
    the median (and 256 MB) are split by AQE; broadcasts stay below 64 MB."""
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.python.worker.reuse": "true",
    }

