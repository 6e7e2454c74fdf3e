"""Token ids in binary shards, compressed by Re-Pair grammars.

Texts are encoded by a public tokenizer, each document closed by an end id,
and laid down in ascending document order. Spark ranges the documents by id; a
task encodes its range as a stream and closes a shard whenever it holds
``SHARD_IDS`` ids. A shard is compressed on its own by Re-Pair: the most
frequent pairs of neighbouring symbols become nonterminals, again and again,
until no pair is frequent or the symbols run out. One round replaces many pairs
at once, in order of their counts, leaving out a pair that could overlap one
already taken, so that a round's replacements never compete.

Shard format (little-endian; one Parquet row a shard, column ``blob``, as
Spark has no sink for raw files): magic ``RPG1``; seven uint64: documents,
ids, first nonterminal, rules, symbols, bytes a symbol, checkpoint step;
int64 document ids; uint8 marks of null ids; uint64 document lengths; uint32
rule pairs; uint64 expansion lengths of the rules; the symbols; uint64 ids
before every ``step``-th symbol. Checkpoints and lengths lead from an id's
position to its symbol, so any range of ids is decoded without the rest.

Words recur, so a task asks the tokenizer only for chunks between ASCII white
space that it has not met yet: this tokenizer never joins characters across
white space. Texts that hold one of its special tokens are encoded whole.

Defined cases: a null text is empty (its end id alone); null doc_ids come
first; rows of one id are ordered by their text, and repeated rows are
documents of their own; a text of any length stays in one shard; empty tables
give no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import python_values

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Ids after which a shard is closed at the next document's end.
SHARD_IDS = 1 << 21
#: Pairs that occur less often in a shard stay as they are.
MIN_COUNT = 16
#: A round takes pairs with at least this share of its highest count.
ROUND_SHARE = 0.01
MAGIC, STEP = b"RPG1", 1024
#: Marks behind a word that the tokenizer never joins to its letters.
MARKS = ".,;:!?"
_MARKS = frozenset(MARKS)


# ---- encoding ------------------------------------------------------------------------------------------------------

class Encoder:
    """Token ids of texts, chunk by chunk; ``keep`` bounds the chunks held."""

    def __init__(self, path: str | None = None, end: int = END, keep: int = 900_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        import public_tokenizers as P

        path = path if path and os.path.exists(path) else str(P.path(os.path.basename(path or TOKENIZER)))
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end, self.keep = end, keep
        self.clear()

    def clear(self) -> None:
        self.known = {}
        self.pool, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    def shrink(self) -> None:
        """Forget the later half of the chunks: frequent ones are met early."""
        n = len(self.known) // 2
        self.known = dict(islice(self.known.items(), n))
        self.used = int(self.lengths[:n].sum())

    def _ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the tokenizer's ids of all chunks, ids per chunk), many chunks a
        call; a token's offset says whose it is."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), 512):
            some = chunks[at:at + 512]
            begins = np.cumsum([0, *map(len, some)]) + np.arange(len(some) + 1)
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            where = np.fromiter(chain.from_iterable(got.offsets), dtype=np.int64)[::2]
            lengths.append(np.diff(np.searchsorted(where, begins)))
            ids.append(np.array(got.ids, dtype=np.uint32))
        return np.concatenate(ids), np.concatenate(lengths)

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Hold the ``ids`` of chunks that are not held yet."""
        n, more = len(self.known), len(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + more > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[n:n + more] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:n + more] = lengths
        self.used += len(ids)
        self.known.update(zip(chunks, range(n, n + more)))

    def _held(self, codes: np.ndarray) -> np.ndarray:
        """The ids of held chunks, one after the other."""
        own = self.lengths[codes]
        return self.pool[np.arange(int(own.sum())) + np.repeat(self.starts[codes] - np.cumsum(own) + own, own)]

    def learn(self, chunks: list[str]) -> None:
        """Add distinct chunks that are not held. A word and the marks behind it
        are learned apart, as the tokenizer always cuts between a letter and
        these marks."""
        parts = {}
        for c in [c for c in chunks if c[-1:] in _MARKS]:
            word = c.rstrip(MARKS)
            if word and word[-1].isalpha() and word[-1] < "\u0250":
                parts[c] = word, c[len(word):]
        own = dict.fromkeys(c for c in chunks if c not in parts)
        own.update(dict.fromkeys(chain.from_iterable(parts.values())))
        new = [c for c in own if c not in self.known]
        self._add(new, *self._ids_of(new))
        if parts:
            codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts.values())), dtype=np.int64, count=2 * len(parts))
            self._add(list(parts), self._held(codes), self.lengths[codes].reshape(-1, 2).sum(axis=1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their ends, ids per text)."""
        if len(self.known) > self.keep:
            self.shrink()
        lower = pc.ascii_lower(texts)  # the tokenizer lower-cases everything
        whole = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            whole |= pc.match_substring(lower, s).to_numpy(zero_copy_only=False)
        lower = pc.if_else(pa.array(whole), "", lower)
        lists = pc.ascii_split_whitespace(lower)
        coded = lists.flatten().dictionary_encode()
        distinct = python_values(coded.dictionary)
        codes = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = [distinct[i] for i in missing]
            self.learn(new)
            codes[missing] = [self.known[c] for c in new]
        # the ids of this piece's chunks side by side, an end behind them, then those of its texts
        own = np.append(self.lengths[codes], 1)
        begin = (np.cumsum(own) - own).astype(np.int32)
        near = np.append(self._held(codes), np.uint32(self.end))
        upto = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        at = np.insert(coded.indices.to_numpy(), upto, len(codes))
        lengths = own.astype(np.int32)[at]
        ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
        ids = near[np.arange(ends[-1], dtype=np.int32) + np.repeat(begin[at] - ends[:-1].astype(np.int32), lengths)]
        sizes = np.diff(ends[np.append(0, upto + np.arange(1, len(upto) + 1))])
        if whole.any():
            cut = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(whole).tolist():
                cut[i] = np.asarray([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.end], dtype=np.uint32)
                sizes[i] = len(cut[i])
            ids = np.concatenate(cut)
        return ids, sizes


def worker_encoder(path: str | None = None) -> Encoder:
    """An encoder that its worker process keeps, with the chunks it has
    learned, for the tasks that come after."""
    kept = sys.modules.setdefault("_poolwise_worker", types.ModuleType("_poolwise_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# ---- grammar -------------------------------------------------------------------------------------------------------

def _chosen(pairs: np.ndarray, counts: np.ndarray, shift: int, least: int, room: int) -> np.ndarray:
    """A round's pairs: the most frequent first, none that could overlap one
    already taken."""
    floor = max(least, int(counts.max() * ROUND_SHARE))
    among = np.flatnonzero(counts >= floor)
    among = among[np.lexsort((pairs[among], -counts[among]))]
    lefts, rights, out = set(), set(), []
    low = (1 << shift) - 1
    for k in among.tolist():
        p = int(pairs[k])
        a, b = p >> shift, p & low
        if a in rights or b in lefts:
            continue
        lefts.add(a)
        rights.add(b)
        out.append(k)
        if len(out) == room:
            break
    return pairs[np.sort(np.asarray(out, dtype=np.int64))] if out else pairs[:0]


def _places(chosen: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: np.ndarray, symbols: int) -> np.ndarray:
    """Where each of ``pairs``, made of symbols of ``chosen`` (``a``, ``b``), is
    in it, or -1. A table of (left, right) while that is small."""
    kind, shift = pairs.dtype.type, 4 * pairs.dtype.itemsize
    lefts, rights = np.unique(a), np.unique(b)
    if len(lefts) * len(rights) > 1 << 22:
        which = np.minimum(np.searchsorted(chosen, pairs), len(chosen) - 1)
        return np.where(chosen[which] == pairs, which, -1)
    row, column = np.zeros(symbols, np.int32), np.zeros(symbols, np.int32)
    row[lefts], column[rights] = np.arange(len(lefts)) * len(rights), np.arange(len(rights))
    table = np.full(len(lefts) * len(rights), -1, np.int32)
    table[row[a] + column[b]] = np.arange(len(chosen))
    return table[row[pairs >> kind(shift)] + column[pairs & kind((1 << shift) - 1)]]


def repair(ids: np.ndarray, first: int, least: int = MIN_COUNT, symbols: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a sequence of ids below ``first``; rule ``k`` is the
    pair that symbol ``first + k`` stands for. ``symbols`` bounds the symbols
    altogether (65,536 if the ids fit, so that a symbol takes two bytes)."""
    if symbols is None:
        symbols = 1 << 16 if first < 1 << 16 else first + (1 << 16)
    shift, kind = (16, np.uint32) if symbols <= 1 << 16 else (32, np.uint64)
    seq, rules, n = np.asarray(ids).astype(kind), [], 0
    left, right = np.zeros(symbols, dtype=bool), np.zeros(symbols, dtype=bool)
    while len(seq) > 1 and first + n < symbols:
        pair = (seq[:-1] << kind(shift)) | seq[1:]
        order = np.sort(pair)
        ends = np.flatnonzero(np.append(order[1:] != order[:-1], True))
        counts = np.diff(ends, prepend=-1)
        often = counts >= least
        if not often.any():
            break
        chosen = _chosen(order[ends[often]], counts[often], shift, least, symbols - first - n)
        a, b = (chosen >> kind(shift)).astype(np.int64), (chosen & kind((1 << shift) - 1)).astype(np.int64)
        left[:], right[:] = False, False
        left[a], right[b] = True, True
        at = np.flatnonzero(left[seq[:-1]] & right[seq[1:]])
        which = _places(chosen, a, b, pair[at], symbols)
        at, which = at[which >= 0], which[which >= 0]
        # only a pair of equal symbols can overlap itself: of a run of hits every second stays
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        turn = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        at, which = at[turn % 2 == 0], which[turn % 2 == 0]
        seq[at] = (first + n + which).astype(kind)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([a, b], axis=1))
        n += len(chosen)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    out = [0] * len(rules)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return np.asarray(out, dtype=np.int64)


class Shard:
    """A shard read from its bytes."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, self.n_ids, self.first, n_rules, n_symbols, width, self.step = struct.unpack_from("<7Q", blob, 4)
        at = 4 + 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist())]
        self.doc_lengths = take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).astype(np.int64).reshape(-1, 2)
        self.lengths = take("<u8", n_rules).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)
        self.checkpoints = take("<u8", -(-n_symbols // self.step)).astype(np.int64)
        self._short()

    def _short(self, most: int = 64) -> None:
        """Whole expansions of the rules of at most ``most`` ids, in one flat
        array; longer rules are opened level by level."""
        flat, starts, kept = [], np.zeros(len(self.rules), dtype=np.int64), {}
        at = 0
        for k in np.flatnonzero(self.lengths <= most).tolist():
            a, b = self.rules[k].tolist()
            own = (kept[a] if a >= self.first else [a]) + (kept[b] if b >= self.first else [b])
            kept[k + self.first] = own
            starts[k] = at
            at += len(own)
            flat.append(own)
        self.most, self.starts = most, starts
        self.flat = np.fromiter(chain.from_iterable(flat), dtype=np.uint32, count=at)

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        inner = symbols >= self.first
        out = np.ones(len(symbols), dtype=np.int64)
        out[inner] = self.lengths[symbols[inner].astype(np.int64) - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that ``symbols`` stand for."""
        symbols = symbols.astype(np.int64)
        while True:
            lengths = self.symbol_lengths(symbols)
            deep = lengths > self.most
            if not deep.any():
                break
            at = np.cumsum(1 + deep) - 1 - deep
            out = np.empty(len(symbols) + int(deep.sum()), dtype=np.int64)
            out[at[~deep]] = symbols[~deep]
            pairs = self.rules[symbols[deep] - self.first]
            out[at[deep]], out[at[deep] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        # terminals lie behind the flat expansions, one each
        inner = symbols >= self.first
        source = np.concatenate([self.flat, symbols[~inner].astype(np.uint32)])
        begin = np.empty(len(symbols), dtype=np.int64)
        begin[inner] = self.starts[symbols[inner] - self.first]
        begin[~inner] = len(self.flat) + np.arange(int((~inner).sum()))
        before = np.cumsum(lengths) - lengths
        return source[np.arange(int(lengths.sum())) + np.repeat(begin - before, lengths)].astype("<u4")

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``start + count - 1`` of the shard; only the symbols
        that hold them are decoded."""
        stop = self.n_ids if count is None else min(self.n_ids, start + count)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        lo = int(np.searchsorted(self.checkpoints, start, side="right")) - 1
        hi = int(np.searchsorted(self.checkpoints, stop, side="left"))
        got = self.expand(self.symbols[lo * self.step:hi * self.step])
        base = int(self.checkpoints[lo])
        return got[start - base:stop - base]

    def documents(self):
        """(doc_id, first position in the shard, ids) of every document."""
        ids, at = self.ids(), 0
        for doc_id, n in zip(self.doc_ids, self.doc_lengths.tolist()):
            yield doc_id, at, ids[at:at + n]
            at += n


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, first: int, least: int = MIN_COUNT) -> bytes:
    """The bytes of a shard."""
    symbols, rules = repair(ids, first, least)
    own = expansion_lengths(rules, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    inner = symbols >= first
    sizes = np.ones(len(symbols), dtype=np.int64)
    sizes[inner] = own[symbols[inner].astype(np.int64) - first]
    before = (np.cumsum(sizes) - sizes)[::STEP]
    return b"".join([
        MAGIC, struct.pack("<7Q", len(doc_ids), len(ids), first, len(rules), len(symbols), width, STEP),
        np.asarray([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.asarray([d is None for d in doc_ids], dtype="u1").tobytes(), np.asarray(lengths, dtype="<u8").tobytes(),
        rules.astype("<u4").tobytes(), own.astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes(), before.astype("<u8").tobytes()])


# ---- on Spark ------------------------------------------------------------------------------------------------------

def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, least: int = MIN_COUNT) -> None:
    """Write the token ids of ``docs`` to ``path``: rows (part, shard, n_docs,
    n_ids, blob), documents ascending over (part, shard)."""
    schema = "part int, shard int, n_docs long, n_ids long, blob binary"
    piece = 8 << 20  # bytes of text encoded at once

    def packed(batches):
        encoder = worker_encoder(tokenizer)
        part, shard = None, 0
        ids, lengths, names = [], [], []

        def close():
            nonlocal shard
            all_ids = np.concatenate(ids)
            blob = pack(names, np.concatenate(lengths), all_ids, encoder.size, least)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int64()),
                                              pa.array([len(all_ids)], pa.int64()), pa.array([blob], pa.binary())],
                                             names=["part", "shard", "n_docs", "n_ids", "blob"])
            shard += 1
            for x in (ids, lengths, names):
                x.clear()
            return row

        for batch in batches:
            if not len(batch):
                continue
            part = batch.column("part")[0].as_py()
            upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(upto // piece)) + 1).tolist(), len(batch)]
            for i, j in zip(cuts, cuts[1:]):
                got, n = encoder.encode(batch.column("text").slice(i, j - i))
                ids.append(got)
                lengths.append(n)
                names.extend(batch.column("doc_id").slice(i, j - i).to_pylist())
                if sum(map(len, ids)) >= shard_ids:
                    yield close()
        if names:
            yield close()

    h = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(packed, schema).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, before): ids before each shard, from sums per part."""
    narrow = spark.read.parquet(path).select("part", "shard", "n_ids")
    parts = narrow.groupBy("part").agg(F.sum("n_ids").alias("total"))
    prior = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = parts.select("part", F.coalesce(F.sum("total").over(prior), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (narrow.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
            .select("part", "shard", (F.col("_base") + F.col("_in")).alias("before")))


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the shards at ``path``: doc_id, start, n_tokens, ids_crc32
    and, if asked for, the ids themselves."""
    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def decoded(batches):
        for batch in batches:
            for p, s, blob in zip(batch.column("part"), batch.column("shard"), batch.column("blob")):
                docs = list(Shard(blob.as_py()).documents())
                out = [pa.array([p.as_py()] * len(docs), pa.int32()), pa.array([s.as_py()] * len(docs), pa.int32()),
                       pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64()),
                       pa.array([len(d[2]) for d in docs], pa.int64()), pa.array([zlib.crc32(d[2]) for d in docs], pa.int64())]
                names = ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([d[2].tolist() for d in docs], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = spark.read.parquet(path).select("part", "shard", "blob").mapInArrow(decoded, schema)
    out = rows.join(shard_starts(spark, path), ["part", "shard"])
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder, read them back and
    report every document."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path, with_ids=False)
