"""The cuckoo index against sets and a plain grouping."""
import hashlib
import random
import re
from collections import defaultdict

from poolwise.llm.cuckoo import CuckooFilter, CuckooIndex, digests_of, exact_duplicates


def test_filter_adds_removes_and_overflows():
    rnd = random.Random(3)
    hashes = [rnd.getrandbits(64) for _ in range(3000)]
    filt = CuckooFilter.holding(hashes, 4)
    assert filt.cells * 4 >= 3000 and all(filt.has(h) for h in hashes)
    again = CuckooFilter(data=filt.to_bytes())
    for h in hashes[:1500]:
        assert again.remove(h)
    assert all(again.has(h) for h in hashes[1500:])
    assert sum(again.has(h) for h in hashes[:1500]) < 20
    small = CuckooFilter(2)
    placed = [h for h in hashes[:50] if small.add(h)]
    assert len(placed) <= 8 and all(small.has(h) for h in placed)


def slow(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[norm[k]].append(i)
    return {t: (min((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}, norm


def test_exact_duplicates(spark):
    rows = [(i, f"word{i % 40}  of\t{i % 40}") for i in range(400)] + [(i, "hot text") for i in range(400, 700)]
    rows += [(1000, None), (1001, ""), (1002, " "), (None, "\n"), (7, "twice"), (7, "twice"), (None, "none"), (8, "é x"),
             (9, "é x"), (10, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, digest string").repartition(5)
    got = exact_duplicates(df).collect()
    want, norm = slow(rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(
        (str(i), str(want[n][0]), want[n][1], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(want) and all(r.doc_id == r.keep_id for r in kept)


def test_insert_delete_lookup_resize(spark):
    df = spark.createDataFrame([(i, f"t{i % 300}") for i in range(900)], "doc_id long, text string")
    rows = digests_of(df)
    index = CuckooIndex(spark, buckets=3, cells=4)
    index.insert(rows.filter("doc_id < 450"))
    index.insert(rows.filter("doc_id >= 450"))
    assert {r.n for r in index.keys().collect()} == {3}
    assert index.keys().count() == 300
    assert min(r.resized for r in index.state.filter("kind = 'filter'").collect()) >= 1
    index.delete(rows.filter("doc_id < 600"))  # two of three
    assert {r.n for r in index.keys().collect()} == {1}
    index.delete(rows.filter("doc_id >= 600 and doc_id < 650"))
    live = {r.digest: r.live for r in index.lookup(rows).collect()}
    assert len(live) == 300 and sum(live.values()) == 250
    index.insert(rows.filter("doc_id = 600"))
    assert index.keys().count() == 251


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
