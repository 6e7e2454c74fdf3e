"""Spelling variants by a bidirectional FM-index.

A word is cut into two halves. If two words differ by one inserted, deleted or
replaced code point, one half of the first occurs unchanged in the second, at
its beginning or at its end. The search therefore has two schemes: match the
first half exactly and go right over the second half allowing one error, or
match the second half exactly and go left over the first half allowing one.
Both run on a bidirectional FM-index of the delimited vocabulary
``$word$word...$`` (a circular text): a pattern is an interval of suffix ranks
in the text and one of the same size in its reverse, and it can be extended on
either side. A neighbour is found when both delimiters are matched; its rank
says which word it is. The edit that leads to a neighbour is put as far as
possible in the direction of the search, so each is found once in a scheme,
and the second scheme leaves out what the first finds.

Both words of a pair share their first or their last ``KEY`` code points (a
half has at least that many). So the vocabulary is dealt by these keys: keys
are packed into blocks by hash, and a key of more than ``block`` words is cut
into several blocks which all of the key's words visit, in chunks. A task
holds one block's index and one chunk of words, never a whole vocabulary.
Tasks return per word a count and the best neighbour, never pairs.

Defined cases: a null text has no words, a null doc_id hashes as the empty
string; repeated rows count each; words of any length are searched whole; ties
go to the smallest word; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Code points that both words of a pair share at one end; a word of at least
#: twice as many has halves that long.
KEY = 3
#: Words of one index, and of one chunk that searches it.
BLOCK = 30_000
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")  # a-z and U+00C0-U+00FF in UTF-8
ERRED = 199
#: Steps of the sampled symbol counts.
STEP = 32


# ---- words of the corpus -------------------------------------------------------------------------------------------

def runs_of(doc_id, text: bytes | None, erred: int = ERRED) -> list[bytes]:
    """The words of one text: lower-cased runs of letters, of which those whose
    hash ``erred`` divides lose one code point."""
    runs = RUN.findall((text or b"").lower())  # bytes: only A-Z change
    if not runs or not erred:
        return runs
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    h = np.fromiter(map(zlib.crc32, runs, repeat(seed)), dtype=np.int64, count=len(runs))
    for i in np.flatnonzero(h % erred == 0).tolist():
        word = runs[i].decode()
        at = int(h[i]) % len(word)
        runs[i] = (word[:at] + word[at + 1:]).encode()
    return runs


def vocabulary(docs: DataFrame, min_length: int = 2 * KEY, min_count: int = 5, erred: int = ERRED, most: int = 400_000) -> DataFrame:
    """(word, n) of all texts. Tasks count into a table of at most ``most``
    words before it is passed on, so the shuffle carries sums."""
    if min_length < 2 * KEY:
        raise ValueError(f"words of fewer than {2 * KEY} code points have no two halves of {KEY}")

    def counted(batches):
        counts = Counter()

        def out():
            words = [w.decode() for w in counts]
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return got

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                counts.update(runs_of(doc_id.as_py(), text.as_py(), erred))
                if len(counts) > most:
                    yield out()
        yield out()

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return (texts.mapInArrow(counted, "word string, n long").filter(F.length("word") >= min_length)
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# ---- the index -----------------------------------------------------------------------------------------------------

def _ranked_rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted rotations of a circular text without period."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while True:
        key = rank * n + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class _Column:
    """The symbols before each sorted rotation, with sampled counts."""

    def __init__(self, last: np.ndarray, sigma: int):
        n = len(last)
        self.sigma, self.last = sigma, last
        rows = n // STEP + 1
        self.windows = np.full(rows * STEP, sigma, dtype=last.dtype)  # beyond the end: larger than every symbol
        self.windows[:n] = last
        self.windows = self.windows.reshape(rows, STEP)
        counts = np.bincount((np.arange(n) // STEP) * sigma + last, minlength=rows * sigma).reshape(rows, sigma)
        #: below[r, c]: symbols under c before window r
        self.below = np.zeros((rows, sigma + 1), dtype=np.int32)
        before = np.cumsum(counts, axis=0) - counts
        self.below[:, 1:] = np.cumsum(before, axis=1)
        self.offsets = np.arange(STEP)

    def under(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among the first ``at`` symbols, how many are under ``symbol`` and
        how many equal it."""
        row, rest = at // STEP, at % STEP
        window = self.windows[row]
        inside = self.offsets < rest[:, None]
        less = self.below[row, symbol]
        same = self.below[row, symbol + 1] - less
        s = symbol.astype(window.dtype)[:, None]
        return less + ((window < s) & inside).sum(axis=1), same + ((window == s) & inside).sum(axis=1)


class Index:
    """Bidirectional FM-index of distinct words. Intervals are arrays
    ``(left, right, size)``: where the pattern's rotations begin among the
    sorted rotations of the text, where the reversed pattern's begin among
    those of the reversed text, and how many there are."""

    def __init__(self, words: list[str]):
        joined = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.symbols, codes = np.unique(joined, return_inverse=True)
        self.sigma = len(self.symbols) + 1  # 0 is the delimiter
        text = np.zeros(len(joined) + len(words), dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
        mark = np.zeros(len(text), dtype=bool)
        mark[self.starts] = True
        text[~mark] = codes.reshape(-1) + 1
        kind = np.uint8 if self.sigma < 255 else np.uint32
        self.order = _ranked_rotations(text)
        turned = text[::-1].copy()
        backwards = _ranked_rotations(turned)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.columns = (_Column(text[self.order - 1].astype(kind), self.sigma), _Column(turned[backwards - 1].astype(kind), self.sigma))
        self.n = len(text)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(matrix of symbols padded with -2, lengths); -1: not in the index."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        at = np.searchsorted(self.symbols, flat)
        known = self.symbols[np.minimum(at, len(self.symbols) - 1)] == flat
        out = np.full((len(words), int(lengths.max(initial=0))), -2, dtype=np.int64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(known, at + 1, -1)
        return out, lengths

    def all(self, count: int):
        return np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64), np.full(count, self.n, dtype=np.int64)

    def extend(self, side: int, here, there, size, symbol):
        """The intervals of the patterns with ``symbol`` put before them (side
        0) or after them (side 1); ``here`` is the interval whose column is
        read. Symbols that the index lacks give size 0."""
        column, c = self.columns[side], np.maximum(symbol, 0)
        less_lo, same_lo = column.under(c, here)
        less_hi, same_hi = column.under(c, here + size)
        return self.first[c] + same_lo, there + less_hi - less_lo, np.where(symbol < 0, 0, same_hi - same_lo)

    def children(self, side: int, here, there, size):
        """All one-symbol extensions but the delimiter: (parent, symbol, here,
        there, size). Small intervals are read symbol by symbol, large ones are
        asked for every symbol of the alphabet."""
        wide = size > 2 * self.sigma
        small, big = np.flatnonzero(~wide), np.flatnonzero(wide)
        sizes = size[small]
        parent = np.repeat(small, sizes)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + here[parent]
        pair = np.unique(parent * self.sigma + self.columns[side].last[at])
        pair = np.concatenate([pair, (big[:, None] * self.sigma + np.arange(1, self.sigma)).reshape(-1)])
        parent, symbol = pair // self.sigma, pair % self.sigma
        parent, symbol = parent[symbol > 0], symbol[symbol > 0]
        got = self.extend(side, here[parent], there[parent], size[parent], symbol)
        keep = got[2] > 0
        return parent[keep], symbol[keep], *(x[keep] for x in got)

    def neighbours(self, words: list[str], scheme: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the query, index of the word found) for all words of the
        index at exactly one error from a query, the error lying in its second
        half (scheme 0) or in its first half (scheme 1). Each once."""
        if not words or not self.n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pattern, lengths = self.coded(words)
        half = lengths // 2
        inner, outer = scheme, 1 - scheme  # the exact half is matched towards its end of the word, then the search turns
        query = np.arange(len(words))
        here, there, size = self.all(len(words))
        exact = half if scheme == 0 else lengths - half
        for k in range(int(exact.max()) + 1):  # the exact half, then its delimiter
            go = (k <= exact[query]) & (size > 0)
            i = query[go]
            at = half[i] - 1 - k if scheme == 0 else half[i] + k
            symbol = np.where(k < exact[i], pattern[i, np.clip(at, 0, pattern.shape[1] - 1)], 0)
            here[go], there[go], size[go] = self.extend(inner, here[go], there[go], size[go], symbol)
        here, there = there, here
        alive = size > 0
        query, here, there, size = query[alive], here[alive], there[alive], size[alive]
        free = lengths - half if scheme == 0 else half

        def symbols(i, j):
            """Symbol ``j`` of the free half in the direction of the search; the
            delimiter behind it."""
            at = half[i] + j if scheme == 0 else half[i] - 1 - j
            return np.where(j < free[i], pattern[i, np.clip(at, 0, pattern.shape[1] - 1)], 0)

        found = ([], [])
        clean = (query, here, there, size)  # one state a query, no error yet
        erred = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        for j in range(int(free.max(initial=0)) + 1):
            q, h, t, s = clean
            wanted = symbols(q, j)
            parent, symbol, ch, ct, cs = self.children(outer, h, t, s)
            other = symbol != wanted[parent]
            inserted = tuple(x[other] for x in (q[parent], ch, ct, cs))  # stays before symbol j
            inside = other & (wanted[parent] != 0)
            replaced = tuple(x[inside] for x in (q[parent], ch, ct, cs))
            drop = (wanted != 0) & (wanted != symbols(q, j + 1))
            deleted = tuple(x[drop] for x in clean)
            erred = tuple(map(np.concatenate, zip(erred, inserted)))
            step = symbols(erred[0], j)
            moved = self.extend(outer, *erred[1:], step)
            done = (step == 0) & (moved[2] > 0)
            found[0].append(erred[0][done])
            ranks = (moved[1] if outer == 1 else moved[0])[done]
            found[1].append(ranks)
            on = (step != 0) & (moved[2] > 0)
            erred = (erred[0][on], *(x[on] for x in moved))
            erred = tuple(map(np.concatenate, zip(erred, replaced, deleted)))
            moved = self.extend(outer, h, t, s, wanted)
            on = (wanted != 0) & (moved[2] > 0)
            clean = (q[on], *(x[on] for x in moved))
        who, ranks = np.concatenate(found[0]), np.concatenate(found[1])
        # the pattern is now delimited on both sides: its only rotation begins at the delimiter before the word
        return who, np.searchsorted(self.starts, self.order[ranks])


def best_neighbours(index: Index, stored: list[str], counts: list[int], queries: list[str], scheme: int, chunk: int = 4000):
    """Per query with neighbours in the index (in one scheme): (query, number,
    count and word of the most frequent). Scheme 1 leaves out words that share
    the query's whole first half, as scheme 0 finds them."""
    weight = np.asarray(counts, dtype=np.int64)
    order = np.empty(len(stored), dtype=np.int64)
    order[sorted(range(len(stored)), key=stored.__getitem__)] = np.arange(len(stored))
    out = []
    for at in range(0, len(queries), chunk):
        part = queries[at:at + chunk]
        who, what = index.neighbours(part, scheme)
        if scheme == 1:
            keep = np.fromiter((not stored[v].startswith(part[w][:len(part[w]) // 2]) for w, v in zip(who.tolist(), what.tolist())),
                               dtype=bool, count=len(who))
            who, what = who[keep], what[keep]
        by = np.lexsort((order[what], -weight[what], who))
        who, what = who[by], what[by]
        firsts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, dtype=np.int64)
        numbers = np.diff(np.append(firsts, len(who)))
        out += [(part[w], n, counts[v], stored[v]) for w, v, n in zip(who[firsts].tolist(), what[firsts].tolist(), numbers.tolist())]
    return out


# ---- on Spark ------------------------------------------------------------------------------------------------------

def _dealt(words: DataFrame, block: int) -> DataFrame:
    """Rows (scheme, deal, part, chunk, word, n, stored, asks): where a word is
    stored in an index and where it searches one."""
    keyed = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("scheme"), F.substring("word", 1, KEY).alias("key")),
        F.struct(F.lit(1).alias("scheme"), F.expr(f"right(word, {KEY})").alias("key")))).alias("k")).select("word", "n", "k.*")
    held = keyed.groupBy("scheme", "key").agg(F.count(F.lit(1)).alias("held"))
    total = words.count()
    blocks = max(1, -(-total // max(1, block // 2)))  # packed by hash to half of a block on average
    h = F.xxhash64("word")
    rows = keyed.join(held, ["scheme", "key"]).withColumn("parts", F.ceil(F.col("held") / block).cast("int"))
    alone = F.col("held") > block
    rows = rows.withColumn("deal", F.when(alone, F.concat(F.lit("="), "key")).otherwise(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("string")))
    home = F.pmod(h, F.col("parts")).cast("int")
    whole = F.sequence(F.lit(0), F.col("parts") - 1)
    visits = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("chunk"), F.lit(True).alias("stored"), F.lit(True).alias("asks")))
                    ).otherwise(F.flatten(F.transform(whole, lambda p: F.array(
                        F.struct(p.alias("part"), home.alias("chunk"), (p == home).alias("stored"), F.lit(True).alias("asks")),
                        F.struct(home.alias("part"), p.alias("chunk"), (p != home).alias("stored"), F.lit(False).alias("asks"))))))
    rows = rows.select("scheme", "deal", "word", "n", F.explode(visits).alias("v")).select("scheme", "deal", "word", "n", "v.*")
    return rows.filter("stored or asks")


def near_counts(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): for each word with near words their number and
    the most frequent one as (n, word)."""
    schema = "word string, n_near long, near_n long, near string"

    def searched(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        stored = [i for i, s in enumerate(rows["stored"]) if s]
        names, counts = [rows["word"][i] for i in stored], [rows["n"][i] for i in stored]
        asking = sorted(w for w, a in zip(rows["word"], rows["asks"]) if a)
        got = best_neighbours(Index(names), names, counts, asking, rows["scheme"][0]) if names and asking else []
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*got) if got else ([], [], [], []), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
            names=["word", "n_near", "near_n", "near"])

    found = _dealt(words, block).groupBy("scheme", "deal", "part", "chunk").applyInArrow(searched, schema)
    first = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("near_n"), "best.near")


def variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = written(words.select("word", "n"), "vocabulary")
    near = near_counts(words, block)
    keeps = F.col("near_n") >= ratio * F.col("n")
    table = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(keeps, F.col("near")).alias("form"), F.when(keeps, F.col("near_n")).alias("form_n")), "spelling-forms")
    # counts grow by the ratio along a chain, so a few doublings reach every end
    links = written(table.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        step = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        on = written(links.join(step, links["root"] == step["_at"], "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-links")
        drop_written(links)
        links = on
        if links.filter("moved").isEmpty():
            break
    out = table.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 2 * KEY, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """The variants among all words of ``docs``."""
    return variants(vocabulary(docs, min_length, min_count), ratio)
