"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves are blocks of
consecutive pre-tokens with their length in characters and their tokens, inner
nodes hold sums. An edit replaces a range of characters. Only the blocks it
touches are tokenized again, starting a block early (a pre-token's end depends
on a few characters after it) and going on until the new pre-tokens meet an old
block border again; then the sums on the ways from those blocks to the root
are updated. Counts always equal those of a full re-encoding.

Documents are independent, so Spark runs whole partitions of them in Arrow
batches, each with a cache of pre-token counts; edits are a column of the
document's row, or a table joined to it.

Defined cases: a null text counts as empty; positions are clamped to the text
as it is when the edit applies, and a stop before its start deletes nothing;
null edits, positions or inserts are none, the text's start and empty; a null
or empty list changes nothing; very long pre-tokens stay in one block;
repeated rows are documents of their own; empty tables give empty results;
other columns are passed through, but those named like a result are replaced.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
#: Characters before an edit that are read again at least.
CONTEXT = 16
EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("insert", T.StringType())])


class Tokens:
    """Pre-tokens of a public byte-level tokenizer and their token counts."""

    def __init__(self, path: str | None = None, keep: int = 400_000):
        import regex
        import tiktoken

        import public_tokenizers as P

        path = path if path and os.path.exists(path) else str(P.path(os.path.basename(path or VOCABULARY)))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(P.PATTERN)
        self.keep, self.cache = keep, {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        get = self.cache.get
        out = [get(p, 0) for p in pieces]
        if 0 in out:
            if len(self.cache) > self.keep:
                self.cache.clear()
            for p in {p for p, n in zip(pieces, out) if not n}:
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    self.cache[p] = n
                else:  # too long to keep
                    out = [n if q == p else k for q, k in zip(pieces, out)]
            out = [k or self.cache[p] for p, k in zip(pieces, out)]
        return out


class Tree:
    """Sums of (characters, tokens) over blocks; ``sums[1]`` is the root."""

    def __init__(self, chars, tokens):
        self.fill(list(chars), list(tokens))

    def fill(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if self.n:
            self.sums[self.size:self.size + self.n, 0] = chars
            self.sums[self.size:self.size + self.n, 1] = tokens
        level = self.size // 2
        while level:
            self.sums[level:2 * level] = self.sums[2 * level:4 * level:2] + self.sums[2 * level + 1:4 * level:2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0]) if self.n else 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1]) if self.n else 0

    def leaves(self) -> np.ndarray:
        return self.sums[self.size:self.size + self.n]

    def find(self, offset: int) -> tuple[int, int]:
        """The block that holds the character at ``offset`` and where it
        begins (the last block for the end of the text)."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if offset >= begin + self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.size, begin

    def replace(self, lo: int, hi: int, chars: list[int], tokens: list[int]) -> None:
        """Put new blocks in place of blocks lo..hi-1: on the spot if they fit
        in, else the tree is laid out anew from its leaves."""
        if hi - lo >= len(chars) > 0 or (hi > lo and not chars):
            pad = hi - lo - len(chars)
            self.sums[self.size + lo:self.size + hi, 0] = chars + [0] * pad
            self.sums[self.size + lo:self.size + hi, 1] = tokens + [0] * pad
            nodes = np.unique((np.arange(lo, hi) + self.size) // 2)
            while len(nodes) and nodes[0] >= 1:
                self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
                nodes = np.unique(nodes // 2)
            return
        old = self.leaves()
        keep = old[:, 0] > 0
        self.fill([*old[:lo][keep[:lo], 0].tolist(), *chars, *old[hi:][keep[hi:], 0].tolist()],
                  [*old[:lo][keep[:lo], 1].tolist(), *tokens, *old[hi:][keep[hi:], 1].tolist()])


def blocks(pieces: list[str], counts: list[int], leaf: int = LEAF) -> tuple[list[int], list[int]]:
    return ([sum(map(len, pieces[i:i + leaf])) for i in range(0, len(pieces), leaf)],
            [sum(counts[i:i + leaf]) for i in range(0, len(counts), leaf)])


class CountedText:
    """A text, its tree, and how many pre-tokens were encoded so far."""

    def __init__(self, tokens: Tokens, text: str, chars=None, counts=None, leaf: int = LEAF):
        self.tokens, self.text, self.leaf, self.encoded = tokens, text, leaf, 0
        if chars is None:
            pieces = tokens.split(text)
            self.encoded = len(pieces)
            chars, counts = blocks(pieces, tokens.counts(pieces), leaf)
        self.tree = Tree(chars, counts)

    def edit(self, start: int, stop: int, insert: str) -> None:
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        shift = len(insert) - (stop - start)
        text = self.text[:start] + insert + self.text[stop:]
        tree = self.tree
        lo, begin = tree.find(max(0, start - CONTEXT)) if tree.n else (0, 0)
        # old block borders at or after the edit, in the new text's positions
        hi, border = lo, begin
        widths = tree.leaves()[:, 0]
        pieces, at = [], begin
        scan = self.tokens.pattern.finditer(text, begin)
        for m in scan:
            while hi < tree.n and (border < stop or border + shift < at):
                border += int(widths[hi])
                hi += 1
            if border >= stop and border + shift == at and hi > lo and at >= start + len(insert) and hi < tree.n:
                break
            pieces.append(m[0])
            at = m.end()
        else:
            hi = tree.n
        chars, counts = blocks(pieces, self.tokens.counts(pieces), self.leaf)
        self.encoded += len(pieces)
        tree.replace(lo, hi, chars, counts)
        self.text = text


def _arrays(trees: list[Tree]) -> tuple[pa.Array, pa.Array]:
    leaves = [t.leaves()[t.leaves()[:, 0] > 0] for t in trees]
    return tuple(pa.array([x[:, k].tolist() for x in leaves], pa.list_(pa.int64())) for k in (0, 1))


def with_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the leaves of their trees (``tree_chars``,
    ``tree_tokens``); inner sums follow from the leaves."""
    docs = docs.drop("tree_chars", "tree_tokens")
    schema = T.StructType([*docs.schema, T.StructField("tree_chars", T.ArrayType(T.LongType())),
                           T.StructField("tree_tokens", T.ArrayType(T.LongType()))])

    def run(batches):
        tokens = Tokens(path)
        for batch in batches:
            trees = [CountedText(tokens, t.as_py() or "").tree for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_arrays(trees)],
                                             names=[*batch.schema.names, "tree_chars", "tree_tokens"])

    return docs.mapInArrow(run, schema)


def with_edits(state: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Attach a table of edits (key, seq, start, stop, insert) to the rows of
    ``state`` as the list ``edits``, in the order of ``seq``."""
    lists = edits.groupBy(F.col(key).alias("_key")).agg(F.expr(
        "transform(array_sort(collect_list(struct(seq, start, stop, insert))), x -> struct(x.start, x.stop, x.insert))").alias("edits"))
    return state.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def apply_edits(state: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of :func:`with_trees` with a list ``edits``, after their edits:
    new text and tree, token counts before and after, and how many pre-tokens
    had to be encoded."""
    extra = ("tokens_before", "tokens_after", "n_edits", "n_encoded")
    keep = [f for f in state.schema if f.name not in ("edits", *extra)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *[T.StructField(c, T.LongType()) for c in extra]])

    def run(batches):
        tokens = Tokens(path)
        for batch in batches:
            out = {c: [] for c in extra}
            texts, trees = [], []
            columns = (batch.column(c) for c in ("text", "tree_chars", "tree_tokens", "edits"))
            for text, chars, counts, edits in zip(*columns):
                doc = CountedText(tokens, text.as_py() or "", chars.as_py() or [], counts.as_py() or [])
                out["tokens_before"].append(doc.tree.tokens)
                todo = [e for e in edits.as_py() or [] if e]
                for e in todo:
                    doc.edit(e["start"] or 0, e["stop"] or 0, e["insert"] or "")
                out["tokens_after"].append(doc.tree.tokens)
                out["n_edits"].append(len(todo))
                out["n_encoded"].append(doc.encoded)
                texts.append(doc.text)
                trees.append(doc.tree)
            chars, counts = _arrays(trees)
            new = {"text": pa.array(texts, pa.string()), "tree_chars": chars, "tree_tokens": counts}
            yield pa.RecordBatch.from_arrays(
                [*[new[c] if c in new else batch.column(c) for c in names], *[pa.array(out[c], pa.int64()) for c in extra]],
                names=[*names, *extra])

    return state.mapInArrow(run, schema)


def derived_edits(doc_id: Column, text: Column) -> Column:
    """Three edits a document, fixed by its id: a deletion, an insertion and
    a replacement at hashed places."""
    size = F.length(F.coalesce(text, F.lit(""))).cast("long")

    def one(k: int, cut: int, insert: str) -> Column:
        h = F.xxhash64(doc_id.cast("string"), F.lit(k))
        start = F.pmod(h, size + 1)
        stop = start + F.pmod(F.shiftrightunsigned(h, 17), F.lit(cut + 1)) if cut else start
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(insert).alias("insert"))

    return F.array(one(1, 60, ""), one(2, 0, " [inserted]\n"), one(3, 24, "it's 2024"))


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Count all documents, apply :func:`derived_edits` and report."""
    rows = docs.select("doc_id", "text", derived_edits(F.col("doc_id"), F.col("text")).alias("edits"))
    out = apply_edits(with_trees(rows, path), path)
    return out.select("doc_id", "tokens_before", "tokens_after", "n_edits", "n_encoded",
                      F.length("text").cast("long").alias("n_chars_after"))
