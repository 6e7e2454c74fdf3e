"""Edits: counts always equal a full encoding; only what is near is read."""
import random

import pytest
from hypothesis import given, settings, strategies as st

from poolwise.llm import token_counts as tc

TOKENS = tc.Tokens()
PIECES = ["a", "word ", "  ", "\n", "it's", "'", "12", "é漢", "...", " x", "\t\t y", "'ll", "I'd", " ", "!"]


def full(text):
    return len(TOKENS.encoding.encode_ordinary(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.lists(st.tuples(
    st.integers(-3, 300), st.integers(-3, 300), st.lists(st.sampled_from(PIECES), max_size=6)), max_size=6),
    st.integers(1, 9))
def test_counts_equal_a_full_encoding(pieces, edits, leaf):
    text = "".join(pieces)
    doc = tc.CountedText(TOKENS, text, leaf=leaf)
    assert doc.tree.tokens == full(text) and doc.tree.chars == len(text)
    for start, stop, insert in edits:
        lo = min(max(start, 0), len(text))
        hi = min(max(stop, lo), len(text))
        text = text[:lo] + "".join(insert) + text[hi:]
        doc.edit(start, stop, "".join(insert))
        assert doc.text == text and doc.tree.tokens == full(text) and doc.tree.chars == len(text)
        assert (doc.tree.leaves().sum(axis=0) == [len(text), doc.tree.tokens]).all()


def test_only_the_region_is_read_again():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(50_000))
    doc = tc.CountedText(TOKENS, text)
    first = doc.encoded
    for _ in range(20):
        at = rnd.randrange(len(doc.text))
        doc.edit(at, at + 5, " new words")
    assert doc.encoded - first < 20 * 6 * tc.LEAF
    assert doc.tree.tokens == full(doc.text)


@pytest.mark.parametrize("text", ["", " ", "x" * 5000, " " * 5000, "\n" * 3000 + "y"])
def test_odd_texts(text):
    doc = tc.CountedText(TOKENS, text)
    for edit in ((0, 0, "ab"), (1, 2, ""), (10 ** 9, 0, " end"), (0, 10 ** 9, ""), (0, 0, "again")):
        doc.edit(*edit)
        assert doc.tree.tokens == full(doc.text) and doc.tree.chars == len(doc.text)


def test_on_spark(spark):
    rows = [(1, "one two three", "k"), (2, None, "k"), (2, "", None), (None, "it's four", "k"), (3, "long " * 20_000, "k"),
            (3, "long " * 20_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tree string")
    edits = spark.createDataFrame([(1, 1, 0, 3, "1"), (1, 2, None, None, None), (2, 1, 0, 0, "new"), (9, 1, 0, 1, ""),
                                   (None, 1, 2, 4, ""), (3, 2, 5, 10, ""), (3, 1, 0, 0, "start ")],
                                  "doc_id long, seq long, start long, stop long, insert string")
    out = tc.apply_edits(tc.with_edits(tc.with_trees(docs), edits)).collect()
    got = sorted((str(r.doc_id), r.text, r.tokens_before, r.tokens_after, r.n_edits) for r in out)
    long = "start " + "long " * 20_000
    long = long[:5] + long[10:]
    want = [("1", "1 two three", full("one two three"), full("1 two three"), 2), ("2", "new", 0, full("new"), 1),
            ("2", "new", 0, full("new"), 1), ("None", "it four", full("it's four"), full("it four"), 1),
            *[("3", long, full("long " * 20_000), full(long), 2)] * 2]
    assert got == sorted(want)
    assert all(sum(r.tree_tokens) == r.tokens_after and sum(r.tree_chars) == len(r.text) for r in out)


def test_query_against_full_encodings(spark):
    from poolwise.llm.queries import op9_token_counts
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", tc.derived_edits(F.col("doc_id"), F.col("text")).alias("edits")).collect()
    want = {}
    for r in rows:
        text = r.text
        for e in r.edits:
            lo = min(e["start"], len(text))
            hi = min(max(e["stop"], lo), len(text))
            text = text[:lo] + e["insert"] + text[hi:]
        want[r.doc_id] = (full(r.text), full(text), 3, len(text))
    got = {r.doc_id: (r.tokens_before, r.tokens_after, r.n_edits, r.n_chars_after) for r in op9_token_counts(spark, sf).collect()}
    assert got == want
    assert tc.edited_counts(docs.limit(0)).collect() == []
