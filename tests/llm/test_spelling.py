"""Spelling variants: the index against all pairs, the corpus query against a
plain version, and the defined cases."""
import random
import re
import zlib
from collections import Counter

import pytest

from poolwise.llm import spelling

SF = "/root/testdata/sf0.001"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_words(rows, erred=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UP, LOW))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % erred == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def slow_variants(words, ratio=5):
    holes = {}
    for w in words:
        for i in range(len(w) + 1):
            holes.setdefault((w[:i], w[i:]), set()).add(w)  # reached by an insertion at i
            if i < len(w):
                holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
    out = {}
    for w in words:
        near = set()
        for i in range(len(w) + 1):
            near |= holes.get((w[:i], w[i:]), set())
            if i < len(w):
                near |= holes.get((w[:i], w[i + 1:]), set())
        near = [v for v in near if v != w and one_error(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (len(near), best if best is not None and words[best] >= ratio * words[w] else None)
    rows = {}
    for w, (n_near, form) in out.items():
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        rows[w] = (form, root, words[w], n_near, words[form] if form else None)
    return rows


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed", range(12))
def test_index_against_all_pairs(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abc", "abé", "abcdefgh"])
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(rng.choice([1, 2, 30, 150]))})
    counts = [rng.randint(1, 5) for _ in words]
    asking = words + [w + "z" for w in words[:5]] + ["zzzzzz", "abzzzzz"]
    index, got = spelling.Index(words), {}
    for scheme in (0, 1):
        for q, n, c, v in spelling.best_neighbours(index, words, counts, asking, scheme, chunk=17):
            held = got.get(q, (0, (1, "")))
            got[q] = held[0] + n, min(held[1], (-c, v))
    for q in asking:
        near = [(-counts[i], w) for i, w in enumerate(words) if one_error(q, w)]
        assert got.get(q) == ((len(near), min(near)) if near else None)


def test_neighbours_come_once():
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "aaabaaa"]
    index = spelling.Index(words)
    for scheme in (0, 1):
        pairs = list(zip(*(x.tolist() for x in index.neighbours(words, scheme))))
        assert len(pairs) == len(set(pairs))


def test_documents_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_variants(slow_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert want and found(spelling.spelling_variants(docs)) == want
    assert any(r[0] for r in want.values())


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_blocks_do_not_change_the_result(spark, block):
    """Keys of more words than a block are cut; every pair is still met."""
    rng = random.Random(5)
    words = {"pre" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 5))) for _ in range(60)}
    words |= {"".join(rng.choice("xyz") for _ in range(6)) for _ in range(60)}
    counts = {w: rng.choice([1, 2, 30, 400]) for w in words}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), block=block))
    assert got == slow_variants(counts)


def test_chains_reach_their_end(spark):
    counts = {"aaaaaaaa": 5 ** 6, "aaaaaaab": 5 ** 5, "aaaaaabb": 5 ** 4, "aaaaabbb": 5 ** 3, "aaaabbbb": 25, "aaabbbbb": 5, "aabbbbbb": 1}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"aaaaaaaa"}


def test_defined_cases(spark):
    long = "abcdef" * 3000
    rows = [(1, "Kitten, KITTEN kitten!", "x", 1), (None, "kitten kitten kittem", "y", 2), (2, None, None, 3), (3, "", "z", 4), (3, "", "z", 4),
            (4, f"{long} {long} {long} {long} {long}", "q", 5), (5, "Übergrößen İstanbul übergrößen", "w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long").withColumnRenamed("n", "key")
    got = found(spelling.spelling_variants(docs, min_count=1))
    plain = slow_words([(r[0], r[1]) for r in rows])
    assert set(got) >= set(plain) and got["kitten"][2] == 5 and got["kittem"][:2] == ("kitten", "kitten")
    assert long in got or any(abs(len(w) - len(long)) <= 1 for w in got)
    assert found(spelling.spelling_variants(docs.limit(0))) == {}
    repeated = found(spelling.spelling_variants(docs.unionByName(docs), min_count=1))
    assert repeated["kitten"][2] == 10
    with pytest.raises(ValueError):
        spelling.vocabulary(docs, min_length=5)
