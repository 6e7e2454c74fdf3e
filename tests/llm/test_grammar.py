"""Token shards: exact round trips, random access and the defined cases."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from poolwise.llm import grammar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return grammar.Encoder()


def library_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [grammar.END]


def test_encoding_equals_the_library(encoder):
    rng = random.Random(3)
    odd = ["a\x0bb\x0cc d\x85e\x1cf\x1dg", "ΑΣ ΟΔΟΣ ΣΑΣ.", "İstanbul İ", "é ́x 한", "x<|endoftext|>y", "it's 'S don't 12 3½ ①", " a  ﬁ ǅ ß",
           "", "  \n\t ", "日本語 テスト。", " <|startoftext|>", "<|ENDOFTEXT|>", "word... what?! É. É,"]
    odd += ["".join(rng.choice("aB'́̀ \n\t\x0b\x85 sStTΣσςéÉÀ.,?1<|>🙂न्") for _ in range(40)) for _ in range(400)]
    ids, sizes = encoder.encode(pa.array(odd))
    want = [library_ids(encoder, t) for t in odd]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_chunks_leave_arrow_as_they_are():
    from poolwise.llm.common import python_values

    some = pa.array(["a", "", "é한🙂", "x" * 500, "a\x00b", None, "\x0b"] * 40)
    for kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        for array in (some.cast(kind), some.cast(kind).slice(3, 50), some.cast(kind).slice(0, 0)):
            assert python_values(array) == array.to_pylist()
    # chunks are asked for once a piece, as plain texts
    small = grammar.Encoder()
    small.encode(pa.array(["one two one", "", "two é."]))
    assert all(type(c) is str for c in small.known) and {"one", "two", "é", "."} <= set(small.known)


def test_forgotten_chunks_are_learned_again():
    small = grammar.Encoder(keep=3)
    for _ in range(3):
        ids, _ = small.encode(pa.array(["one two three four five", "six seven."]))
        assert ids.tolist() == library_ids(small, "one two three four five") + library_ids(small, "six seven.")


def test_a_full_encoder_forgets_the_later_half_only():
    some = grammar.Encoder(keep=6)
    early, late = "the of and", "zyx, wvu! tsr? qpo; nml: kji."
    some.encode(pa.array([early]))
    some.encode(pa.array([late]))
    before = some.known["of"]
    ids, _ = some.encode(pa.array([late + " hgf. of"]))
    assert some.known["of"] == before
    assert ids.tolist() == library_ids(some, late + " hgf. of")
    assert some.used == some.lengths[:len(some.known)].sum()


def test_pairs_are_placed_by_table_and_by_search_alike():
    rng = np.random.default_rng(4)
    a, b = np.repeat(np.arange(0, 3000, 3), 2), rng.integers(3000, 60_000, 2000)
    every = np.unique((a.astype(np.uint32) << 16) | b.astype(np.uint32))
    for chosen in (every[::40], every):  # a small table; one that would be too large
        a, b = (chosen >> 16).astype(np.int64), (chosen & 0xFFFF).astype(np.int64)
        pairs = (rng.choice(a, 5000).astype(np.uint32) << np.uint32(16)) | rng.choice(b, 5000).astype(np.uint32)
        pairs = np.concatenate([pairs, chosen])
        number = {p: k for k, p in enumerate(chosen.tolist())}
        assert grammar._places(chosen, a, b, pairs, 1 << 16).tolist() == [number.get(p, -1) for p in pairs.tolist()]


@pytest.mark.parametrize("seed", range(40))
def test_grammar_round_trip_and_random_access(seed):
    rng = random.Random(seed)
    ids = np.asarray([rng.randrange(rng.choice([2, 3, 10])) for _ in range(rng.choice([1, 2, 5, 300, 3000]))], dtype=np.uint32)
    symbols, rules = grammar.repair(ids, 10, least=2)
    shard = grammar.Shard(grammar.pack([7], [len(ids)], ids, 10, 2))
    assert shard.ids().tolist() == ids.tolist() and len(symbols) <= len(ids)
    assert shard.lengths.tolist() == grammar.expansion_lengths(rules, 10).tolist()
    for _ in range(10):
        at, n = rng.randrange(len(ids) + 1), rng.randrange(len(ids) + 2)
        assert shard.ids(at, n).tolist() == ids[at:at + n].tolist()


def test_rules_are_pairs_that_recur():
    ids = np.asarray([1, 2, 3] * 500 + [4] * 301, dtype=np.uint32)
    symbols, rules = grammar.repair(ids, 10, least=2)
    assert len(symbols) + 2 * len(rules) < 60
    assert (rules < 10 + np.arange(len(rules))[:, None]).all()  # a rule only uses what was there before it


def test_large_ids_and_full_symbol_space():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 70_000, 4000).astype(np.uint32)
    ids = np.concatenate([ids, ids])
    assert grammar.Shard(grammar.pack([1], [8000], ids, 70_000, 2)).ids().tolist() == ids.tolist()
    symbols, rules = grammar.repair(ids % 50, 50, least=2, symbols=55)
    assert len(rules) == 5


def test_long_expansions_open_level_by_level():
    shard = grammar.Shard(grammar.pack([None], [100_000], np.zeros(100_000, dtype=np.uint32), 10, 2))
    assert shard.doc_ids == [None] and len(shard.symbols) < 20
    assert shard.ids().tolist() == [0] * 100_000 and shard.ids(99_990).tolist() == [0] * 10


def check(df, rows, encoder):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    want, at = [], 0
    for doc_id, text in ordered:
        ids = library_ids(encoder, text)
        want.append((doc_id, at, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()], key=lambda r: r[1]) == want


@pytest.mark.parametrize("shard_ids", [1, 5000, grammar.SHARD_IDS])
def test_documents(spark, encoder, tmpdir_path, shard_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar.write_shards(docs.repartition(3), f"{tmpdir_path}/s{shard_ids}", shard_ids=shard_ids)
    check(grammar.read_documents(spark, f"{tmpdir_path}/s{shard_ids}", with_ids=False), [(r.doc_id, r.text) for r in docs.collect()], encoder)


def test_ids_are_read_back(spark, encoder, tmpdir_path):
    docs = spark.createDataFrame([(2, "b c"), (1, "Hello, hello!")], "doc_id long, text string")
    grammar.write_shards(docs, f"{tmpdir_path}/ids")
    got = {r.doc_id: r.ids for r in grammar.read_documents(spark, f"{tmpdir_path}/ids").collect()}
    assert got == {1: library_ids(encoder, "Hello, hello!"), 2: library_ids(encoder, "b c")}


def test_defined_cases(spark, encoder):
    rows = [(5, None), (None, "x y"), (3, ""), (4, "long " * 60_000), (9, "z" * 3000), (7, "a"), (7, "a")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, part string, shard int")
    check(grammar.token_table(docs), rows, encoder)
    assert grammar.token_table(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        grammar.Shard(b"none")
