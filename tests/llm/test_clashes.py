"""Extra columns with the names that the operators use inside: no operator or
stage crashes, changes a value of theirs, or gives another result."""
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from poolwise.llm import (chat, cuckoo, decontam, grammar, lm, mixing, repair, sharding, simhash, spelling, token_counts, toxicity,
                          warc)

SF = "/root/testdata/sf0.001"
SOURCES = Path(lm.__file__).parent.glob("*.py")
OWN = {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "conv_id", "turn", "role", "item_id", "quality"}


def inner_names():
    """Every quoted word of the subpackage that can name a column."""
    found = set()
    for path in SOURCES:
        found |= set(re.findall(r'"([A-Za-z_][A-Za-z0-9_]*)"', path.read_text()))
    return sorted({n for n in found if len(n) < 20} - OWN, key=str.lower)


NAMES = list({n.lower(): n for n in inner_names()}.values())


def widened(df):
    """``df`` with a string column for every inner name."""
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n.lower() not in taken])


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    return {t: read(t).coalesce(2) for t in ("documents", "labels", "benchmark", "pages", "conversations")}


def rows(df, columns=None):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def test_there_are_names_to_test():
    assert {"_k", "_t", "_tag", "_copies", "_score", "_rid", "_domain", "_label", "toxic", "key", "word"} <= set(NAMES)


OPERATORS = {
    "warc": lambda t: warc.deduplicated_pages(t["pages"]),
    "chat": lambda t: chat.parsed_transcripts(t["conversations"]),
    "simhash": lambda t: simhash.simhash_table(t["documents"]),
    "decontam": lambda t: decontam.contamination(t["documents"], t["benchmark"]),
    "sharding": lambda t: sharding.shard_by_bytes(t["documents"]).drop("slot"),
    "cuckoo": lambda t: cuckoo.exact_duplicates(t["documents"]),
    "mixing": lambda t: mixing.mixing_table(t["documents"], t["labels"]),
    "lm": lambda t: lm.score(t["documents"], steps=3, one_in=1_000_000),
    "token_counts": lambda t: token_counts.edited_counts(t["documents"]),
    "toxicity": lambda t: toxicity.toxicity(t["documents"], t["labels"], max_rows=60),
    "spelling": lambda t: spelling.spelling_variants(t["documents"], min_count=2),
    "grammar": lambda t: grammar.token_table(t["documents"]),
    "repair": lambda t: repair.damaged_and_repaired(t["conversations"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(tables, name):
    run = OPERATORS[name]
    wide = {k: widened(df) if k != "labels" else df for k, df in tables.items()}
    assert rows(run(wide)) == rows(run(tables))


@pytest.mark.parametrize("name,stage", [s for s in cp.STAGES if s[0] != "sharding"])
def test_stage(spark, tables, name, stage):
    plain, wide = stage(spark, tables["documents"], SF), stage(spark, widened(tables["documents"]), SF)
    assert wide.columns == widened(tables["documents"]).columns
    assert rows(wide, plain.columns) == rows(plain)
    own = [n for n in wide.columns if n not in plain.columns]
    assert wide.select(*[F.min(n).alias(n) for n in own]).first().asDict() == {n: f"own {n}" for n in own}


def test_counted_texts_replace_their_own_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, tree_chars string, n_edits int")
    state = token_counts.with_trees(docs).withColumn("edits", F.expr("array(struct(0L as start, 1L as stop, 'c' as insert))"))
    row = token_counts.apply_edits(state).first()
    assert row.text == "c b" and row.n_edits == 1
