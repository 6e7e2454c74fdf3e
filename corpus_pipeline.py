"""A corpus from raw documents to shards, five operators in a row.

Each stage is written as Parquet in the shared folder and read again as the
next one's documents, so a lost executor never reaches back over a stage.

1. toxicity: documents at or above their language's threshold go;
2. SimHash near-duplicates: one document of each group stays;
3. benchmark decontamination: documents with a benchmark window go;
4. mixing: documents are repeated by their rate. ``least=1`` keeps every
   document at least once, so the mixture is reached by repeating, never by
   dropping clean documents;
5. sharding by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolwise.llm import decontam, mixing, sharding, simhash, toxicity
from poolwise.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs, shingle=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), power=0.9, least=1.0)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifiers and fingerprints are beyond SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
