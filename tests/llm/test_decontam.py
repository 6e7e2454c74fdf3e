"""Phrase and proximity matches against a scan of every position."""
import hashlib
import random
import re

from poolwise.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows(text, n):
    w = words(text)
    return [w[i:i + n] for i in range(max(len(w) - n, 0) + 1)] if w else []


def slow(docs, items, n=10):
    out = []
    wins = [(str("" if i is None else i), x) for i, t in items for x in windows(t, n)]
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for name, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s:s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    names.add(name)
        out.append((str(doc_id), len(w), len(hit), len(names),
                    hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def fast(spark, docs, items, n=10):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, wid int")
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in decontam.contamination(d, b, n).collect())


def sample(seed, vocab, n_docs, longest):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, longest)))) for i in range(n_docs)]


def test_against_scan(spark):
    vocab = "a b c dé É9 f".split()
    docs = sample(1, vocab, 60, 80) + [(None, None), (3, ""), (3, "a a a a a a"), (3, "a a a a a a"), (-1, "?!")]
    items = sample(2, vocab, 12, 7) + [(100, "a"), (100, "b c"), (None, "É9 f"), (101, None), (102, "..."), (103, "zzz a b c")]
    assert fast(spark, docs, items, 4) == slow(docs, items, 4)


def test_hot_passage_and_long_text(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(i, f"x{i} {passage.upper()} y" if i % 2 else f"clean {i} one two") for i in range(200)]
    docs += [(500, "filler " * 30_000 + passage + " one" * 1000)]
    items = [(1, passage), (2, "ONE, two; three-four five six seven eight nine ten"), (3, "one two")]
    got = fast(spark, docs, items)
    assert got == slow(docs, items)


def test_empty(spark):
    docs = [(1, "a b"), (2, None)]
    assert fast(spark, docs, []) == slow(docs, [])
    assert fast(spark, [], [(1, "a b")]) == []


def test_filter_keeps_columns_and_clean_rows(spark):
    d = spark.createDataFrame([(1, "a b c", "en"), (1, "x", "de"), (None, "a b c", None), (2, None, "fr")],
                              "doc_id long, text string, lang string")
    b = spark.createDataFrame([(1, "b C")], "item_id long, text string")
    kept = decontam.without_contaminated(d, b)
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(
        map(str, d.filter("text is null or text = 'x'").collect()))


def test_proximity(spark):
    vocab = "a b c d e f g".split()
    docs, items, slop = sample(5, vocab, 30, 30), sample(6, vocab, 6, 4), 2
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    wins, _ = decontam.windows_of(b, 3)
    terms = decontam.vocabulary(wins)
    index = decontam.build_index(d, terms)
    got = {(r.wid, r._k, r.start) for r in decontam.proximity_matches(index, wins, terms, slop).collect()}
    freq = {}
    for _, t in docs:
        for x in words(t):
            freq[x] = freq.get(x, 0) + 1
    number = {r.word: r.term for r in terms.collect()}
    want = set()
    for r in wins.collect():
        if any(x not in freq for x in r.words):
            continue
        order = sorted(range(len(r.words)), key=lambda o: (freq[r.words[o]], o, number[r.words[o]]))
        for k, t in docs:
            w = words(t)
            for p in (p for p, x in enumerate(w) if x == r.words[order[0]]):
                s = p - order[0]
                if all(any(0 <= q < len(w) and w[q] == r.words[o] for q in range(s + o - slop, s + o + slop + 1))
                       for o in order[1:]):
                    want.add((r.wid, k, s))
    assert want and got == want
