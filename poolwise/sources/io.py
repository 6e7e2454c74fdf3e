"""Sources and sinks.

Readers always pass an explicit schema; ids are strings. Sinks that the
selection loop re-runs are idempotent and versioned: a write adds files, then one
commit record makes them the table, so a retried round appends no duplicates and
a write that dies changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import strip_ws
from ..schemas import FEATURE_STORE, MANIFEST


def parse_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Every line of a JSON-lines manifest; ``_bad`` holds the text of a line
    that is malformed or names no item, and is NULL for good ones."""
    whole = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]
                         + [T.StructField("_corrupt_record", T.StringType(), True)])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", whole, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_r"))
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull() | F.col("_r.video_id").isNull()
    return parsed.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields],
                         F.when(bad, F.col("value")).alias("_bad"))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST,
                  on_bad: str = "fail") -> DataFrame:
    """JSON-lines manifest. A malformed line never becomes a row: it raises
    (``on_bad='fail'``) or is left out (``'quarantine'``; see
    :func:`parse_manifest` for the lines themselves)."""
    if on_bad not in ("fail", "quarantine"):
        raise ValueError(on_bad)
    parsed = parse_manifest(spark, path, schema)
    if on_bad == "fail":
        for row in parsed.filter(F.col("_bad").isNotNull()).select("_bad").limit(1).collect():
            raise ValueError(f"malformed manifest line: {row['_bad'][:200]!r}")
    return parsed.filter(F.col("_bad").isNull()).drop("_bad")


def read_id_list(spark: SparkSession, path: str, col: str = "video_id") -> DataFrame:
    """Text file, one id per line, stripped of surrounding whitespace of any
    kind (blank lines give ''); order-free, duplicates kept."""
    return spark.read.text(path).select(strip_ws("value").alias(col))


def read_feature_store(spark: SparkSession, path: str, schema: T.StructType = FEATURE_STORE) -> DataFrame:
    """Long-form feature store ``(key, pos, vec)`` in Parquet."""
    return spark.read.schema(schema).parquet(path)


def write_id_list(df: DataFrame, path: str, col: str = "video_id") -> None:
    """One id per line (text), replacing the folder."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_ids(df: DataFrame, path: str, partition_cols=("fold", "iteration")) -> None:
    """Record the ids accepted in a fold and round, as a new version in which
    the partitions of ``df`` replace their older selves and all others are
    referred to. Re-running a round is idempotent, unlike a plain append."""
    write_version(df, path, partition_cols, replace_all=False)


def overwrite_ids(df: DataFrame, path: str) -> None:
    """Write the voted ids as a new version that replaces the old one; a write
    that fails leaves the old one as it is."""
    write_version(df, path)


# --- versioned tables --------------------------------------------------------
# <path>/data-<uuid>/...          files of one write, never changed
# <path>/_commits/<number>.json   what a version consists of: partition -> folder


def _store_of(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _store_of(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version_record(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The commit record of a version (default: the last); None without any."""
    numbers = _commits(spark, path)
    if version is None and not numbers:
        return None
    number = numbers[-1] if version is None else version
    target, fs = _store_of(spark, f"{path}/_commits/{number:012d}.json")
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_version(df: DataFrame, path: str, partition_cols=(), replace_all: bool = True) -> int:
    """Write ``df`` as the next version of the table at ``path``: its files go
    to a folder of their own, then one record, put in place by a rename, makes
    them the table. Until then, and if the write dies, readers see the version
    before. With ``partition_cols`` and not ``replace_all`` the partitions that
    ``df`` does not hold are taken over. Another writer's commit in between is
    an error. Returns the version's number."""
    spark, cols = df.sparkSession, list(partition_cols)
    last = _commits(spark, path)
    old = version_record(spark, path) if last and not replace_all else None
    folder = f"data-{uuid.uuid4().hex}"
    out = df
    for c in cols:  # the columns stay in the files, their copies name the folders
        out = out.withColumn(f"_by_{c}", F.col(c))
    writer = out.write.partitionBy(*[f"_by_{c}" for c in cols]) if cols else out.write
    writer.parquet(f"{path}/{folder}")
    if cols:
        pattern, fs = _store_of(spark, f"{path}/{folder}/" + "/".join("*" for _ in cols))
        found = [str(x.getPath()) for x in fs.globStatus(pattern) if x.isDirectory()]
        parts = {p.split(f"/{folder}/", 1)[1]: folder + "/" + p.split(f"/{folder}/", 1)[1] for p in found}
    else:
        parts = {"": folder}
    number = (last[-1] if last else -1) + 1
    record = {"version": number, "schema": df.schema.json(), "parts": {**(old["parts"] if old else {}), **parts}}
    draft, fs = _store_of(spark, f"{path}/_commits/.{folder}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()
    final, _ = _store_of(spark, f"{path}/_commits/{number:012d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was written by someone else")
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at ``path`` as its last whole version (or an older one) says."""
    record = version_record(spark, path, version)
    if record is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    schema = T.StructType.fromJson(json.loads(record["schema"]))
    folders = [f"{path}/{p}" for p in sorted(record["parts"].values())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the commits but the last ``keep`` and the write folders that none
    of these refers to (also those of writes that died; run it when no write is
    on its way). Returns the number of folders removed."""
    numbers = _commits(spark, path)
    used = {p.split("/", 1)[0] for n in numbers[-keep:] for p in version_record(spark, path, n)["parts"].values()}
    for n in numbers[:-keep]:
        target, fs = _store_of(spark, f"{path}/_commits/{n:012d}.json")
        fs.delete(target, False)
    root, fs = _store_of(spark, path)
    gone = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("data-") and x.getPath().getName() not in used]
    for target in gone:
        fs.delete(target, True)
    return len(gone)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
