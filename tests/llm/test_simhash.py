"""SimHash against a brute-force version over all pairs."""
import random

import pytest
import xxhash

from poolwise.llm import simhash
from poolwise.llm.common import written

WHITE = " \t\n\r\x0b\x0c"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in WHITE:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, max_bits=2):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= max_bits:
                up[root(a)] = root(b)
    return {f: root(f) for f in fps}


def signed(f):
    return f - 2 ** 64 if f >= 2 ** 63 else f


def same_classes(got, want):
    assert got.keys() == want.keys()
    pairs = {(got[f], want[f]) for f in got}
    assert len(pairs) == len(set(got.values())) == len(set(want.values()))


TEXTS = [None, "", " \n", "one", "One  two", "a b c", "A B\tc", "ÀÉ b c d", "x " * 3000 + "y", "a b c d e f", "q w e r t y " * 40]


def test_fingerprints(spark):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice("ab cd ef gh Ij".split()) for _ in range(rnd.randint(1, 60))) for _ in range(50)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _fp_ string")
    got = {r.doc_id: r.fingerprint for r in simhash.simhash_table(df).collect()}
    assert got == {i: f"{slow_fingerprint(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("max_bucket,max_bits", [(1, 2), (3, 1), (64, 2), (3, 0)])
def test_classes_with_hot_keys(spark, max_bucket, max_bits):
    rnd = random.Random(max_bucket)
    fps = {rnd.getrandbits(64) for _ in range(40)} | {0, 1, 2 ** 64 - 1, 2 ** 63}
    for base in list(fps)[:6]:  # clouds around a few centres
        for _ in range(40):
            f = base
            for _ in range(rnd.randint(1, 5)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    df = spark.createDataFrame([(signed(f),) for f in fps], "_fp long")
    edges = simhash.links(df, max_bits, max_bucket)
    true = {(a, b) for a in map(signed, fps) for b in map(signed, fps)
            if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= max_bits}
    found = {(r.a, r.b) for r in edges.collect()}
    assert found <= true
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    same_classes({signed(f): label.get(signed(f), signed(f)) for f in fps},
                 {signed(f): signed(r) for f, r in slow_components(fps, max_bits).items()})


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    df = written(spark.createDataFrame(edges, "a long, b long"), "edges")
    label = {r.node: r.label for r in simhash.components(df).collect()}
    assert label == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_ids_nulls_and_repeats(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "z y x w"), (3, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.simhash_table(df).collect()), key=str)
    assert got == [("3", 3), ("5", 3), ("7", 7), ("7", 7), ("None", 7), ("None", None)]
    kept = simhash.without_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "None"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert simhash.simhash_table(df).collect() == []
    assert simhash.without_near_copies(df).collect() == []


def test_whole_query_against_all_pairs(spark):
    from poolwise.llm.queries import op3_simhash

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    roots = slow_components(fps.values())
    least = {}
    for i in sorted(docs, reverse=True):
        least[roots[fps[i]]] = i
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", least[roots[fps[i]]]) for i in docs}


def test_every_link_comes_once(spark):
    """All pairs at up to two bits, each from one of its common keys, in a
    stream of any batch size."""
    rnd = random.Random(8)
    fps = set()
    for _ in range(40):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(12):
            fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = sorted(map(signed, fps))
    want = sorted((a, b) for i, b in enumerate(fps) for a in fps[:i] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2)
    df = spark.createDataFrame([(f,) for f in fps], "_fp long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted((r.a, r.b) for r in simhash.links(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
