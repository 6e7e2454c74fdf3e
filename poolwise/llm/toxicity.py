"""Toxicity by a convolutional text classifier.

A word's embedding is the mean of hashed vectors of the word and its character
n-grams. Filters of several widths run over the word sequence; each filter's
maximum over the *whole* text (long texts are read in overlapping pieces, the
maxima merged) goes into a logistic output. Everything is trained in numpy,
data-parallel on *all* labelled rows (:func:`refine`); where the tasks set out
from is a classifier trained on a bounded, documented sample of them. Scoring
runs in Arrow batches over all documents.

One embedding dimension starts from the n-grams' log odds between the labels,
counted over all rows, so the filters find telling words from the first step;
all of it is then trained by Adam.

A score is a function of the text alone. The decision is calibrated by
language afterwards: on all labelled rows that the training did not see (a hash
of the id keeps a fifth from it), each language gets the threshold with the best
F1 (``DEFAULT_THRESHOLD`` where a language has too few rows of either kind).

Defined cases: a null text scores as an empty one; labels that are null or not
0/1 are ignored and an id with both labels counts as toxic; ids that are null
are never training rows; every row of a repeated id is one; without labelled rows of both kinds every score is
the share of toxic ones (0.5 without labels); repeated rows give repeated
results; empty tables give empty results; other columns are ignored or, in the
filter, passed through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .averaging import SCHEMA, averaged, moves
from .common import drop_written, fresh_names, sample_of_texts, with_row_key, written

DEFAULT_THRESHOLD = 0.7
BUCKETS = 1 << 15
DIM = 16
FILTERS = 12
WIDTHS = (1, 2, 3)
PIECE = 1 << 15
#: ASCII: letters lower-cased, digits kept, the rest a space; other bytes kept.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def gram_buckets(tokens: list[bytes], chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words, one word after the other, and how many each
    has: the word itself and its 3- to 6-byte pieces, with marks at its ends."""
    parts = [_chunk_buckets(tokens[at:at + chunk]) for at in range(0, len(tokens), chunk)]
    return (np.concatenate([np.zeros(0, np.uint16), *[b for b, _ in parts]]),
            np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]]))


def _chunk_buckets(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    from zlib import crc32

    size = np.array([len(w) + 2 for w in tokens], dtype=np.int64)
    raw = np.frombuffer(b"".join(b"<%b>" % w for w in tokens), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(tokens)), size)
    found = [np.array([crc32(w) & (BUCKETS - 1) for w in tokens], dtype=np.uint16)]
    owners = [np.arange(len(tokens))]
    roll = raw
    for n in range(2, 7):
        if len(raw) < n:
            break
        roll = roll[:-1] * np.uint32(31) + raw[n - 1:]
        if n > 2:
            inside = owner[:len(roll)] == owner[n - 1:]
            found.append((((roll + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.uint16)[inside])
            owners.append(owner[:len(roll)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(tokens))


@dataclass
class Convnet:
    grams: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator, odds: np.ndarray | None = None) -> "Convnet":
        grams = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        if odds is not None:
            grams[:, 0] = odds
            for w, f in zip(WIDTHS, filters):
                f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5 / w
        out = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(grams, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, 0.0)

    def embed(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Embeddings of words given by :func:`gram_buckets`."""
        if not len(counts):
            return np.zeros((0, DIM), np.float32)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(self.grams[flat], starts, axis=0) / counts[:, None].astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Each word's part in the response of every place of every filter."""
        return x @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def responses(self, every: np.ndarray) -> list[np.ndarray]:
        """Per width, every filter's response starting at every word of the
        projected sequence, which ends with ``max(WIDTHS) - 1`` words of
        padding."""
        n = len(every) - max(WIDTHS) + 1
        out, at = [], 0
        for w in WIDTHS:
            z = every[:n, at:at + FILTERS].copy()
            for j in range(1, w):
                z += every[j:n + j, at + j * FILTERS: at + (j + 1) * FILTERS]
            out.append(z)
            at += w * FILTERS
        return out

    def pooled(self, every: np.ndarray, pad: bool = True) -> np.ndarray:
        """Maximum of each filter over one whole text (an empty one counts as
        one word of padding)."""
        if pad:
            every = np.concatenate([every, np.zeros((max(WIDTHS) - (len(every) > 0), every.shape[1]), np.float32)])
        return np.concatenate([z.max(axis=0) for z in self.responses(every)])

    def score(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + np.concatenate(self.biases), 0)
        return 1 / (1 + np.exp(-(hidden.astype(np.float64) @ self.out + self.shift)))


def _numbered(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """The texts as word numbers, and the words."""
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], dtype=np.int64) for t in texts]
    return docs, list(number)


def _seen(docs: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per label, the number of texts with each bucket."""
    seen, mark = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, bool)
    for ids, label in zip(docs, y):
        if len(ids):
            mark[:] = False
            mark[_lists(flat, starts, np.unique(ids))[0]] = True
            seen[label] += mark
    return seen


def _odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log odds of the buckets between the labels, of which there are
    ``texts``."""
    share = (seen + 1) / (texts[:, None] + 2)
    trust = seen.sum(axis=0) / (seen.sum(axis=0) + 3)
    return (np.clip(np.log(share[1] / share[0]), -3, 3) * trust).astype(np.float32)


def _lists(flat: np.ndarray, starts: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of some of the words."""
    n = starts[picked + 1] - starts[picked]
    at = np.arange(n.sum()) + np.repeat(starts[picked] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return flat[at], n


def train(texts: list[str | None], labels: list[int], epochs: int = 8, batch: int = 48, rate: float = 0.01,
          seed: int = 7, odds: np.ndarray | None = None) -> Convnet:
    """Fit a classifier; the classes are weighted to equal shares. ``odds``:
    the buckets' log odds, if not those of these texts."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        net = Convnet.fresh(rng)
        net.out[:] = 0
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        net.shift = float(np.log(share / (1 - share)))
        return net
    docs, flat, starts = _bucketed(texts)
    n = np.bincount(y, minlength=2)
    net = Convnet.fresh(rng, _odds(_seen(docs, flat, starts, y), n) if odds is None else odds)
    _descend(net, docs, flat, starts, y, (len(y) / (2 * n))[y], rng, {}, epochs, batch, rate)
    return net


def _bucketed(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The texts as word numbers, all words' buckets and where each begins."""
    docs, vocab = _numbered(texts)
    flat, counts = gram_buckets(vocab)
    return docs, flat, np.concatenate([[0], np.cumsum(counts)])


def _peaks(net: Convnet, projected: np.ndarray, ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per width where each filter is largest, and its largest responses; a
    long text is read in pieces. ``ids`` ends with padding."""
    ahead, every = max(WIDTHS) - 1, np.arange(FILTERS)
    where, best = None, None
    for at in range(0, len(ids) - ahead, PIECE):
        z = net.responses(projected[ids[at:at + PIECE + ahead]])
        top = [a.argmax(axis=0) for a in z]
        value = [a[k, every] for a, k in zip(z, top)]
        if where is None:
            where, best = top, value
        else:
            won = [v > b for v, b in zip(value, best)]
            where = [np.where(w, k + at, o) for w, k, o in zip(won, top, where)]
            best = [np.maximum(v, b) for v, b in zip(value, best)]
    return where, np.concatenate(best)


def _descend(net: Convnet, docs: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray,
             rng: np.random.Generator, state: dict[str, list], epochs: int, batch: int, rate: float) -> None:
    """Train ``net`` on texts of :func:`_bucketed`; ``state`` is Adam's."""
    def adam(name: str, value: np.ndarray, grad: np.ndarray, lr: float) -> np.ndarray:
        m = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        m[2] += 1
        m[0] += 0.1 * (grad - m[0])
        m[1] += 0.01 * (grad * grad - m[1])
        return value - lr * (m[0] / (1 - 0.9 ** m[2])) / (np.sqrt(m[1] / (1 - 0.99 ** m[2])) + 1e-6)

    pad = max(WIDTHS) - 1
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 1e-3
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            used = np.unique(np.concatenate([docs[i] for i in pick])) if sum(len(docs[i]) for i in pick) else np.zeros(0, int)
            buckets, sizes = _lists(flat, starts, used)
            rows = np.concatenate([net.embed(buckets, sizes), np.zeros((1, DIM), np.float32)])
            projected = net.project(rows)
            g_rows = np.zeros_like(rows)
            g_filters = [np.zeros_like(f) for f in net.filters]
            g_bias, g_out, g_shift = [np.zeros_like(b) for b in net.biases], np.zeros_like(net.out), 0.0
            for i in pick:
                ids = np.concatenate([np.searchsorted(used, docs[i]), np.full(pad + (len(docs[i]) == 0), len(used))])
                where, raw = _peaks(net, projected, ids)
                raw = raw + np.concatenate(net.biases)
                keep = rng.random(len(raw)) < 0.8  # dropout
                hidden = np.maximum(raw, 0) * keep / 0.8
                p = 1 / (1 + np.exp(-(float(hidden @ net.out) + net.shift)))
                d = (p - y[i]) * weight[i] / len(pick)
                g_out += d * hidden
                g_shift += d
                dh = (d * net.out * (raw > 0) * keep / 0.8).reshape(len(WIDTHS), FILTERS)
                for k, w in enumerate(WIDTHS):
                    g_bias[k] += dh[k]
                    for j in range(w):
                        at_j = ids[where[k] + j]
                        g_filters[k][j] += (rows[at_j] * dh[k][:, None]).T
                        np.add.at(g_rows, at_j, net.filters[k][j].T * dh[k][:, None])
            net.filters = [adam(f"f{k}", f, g + 1e-4 * f, lr) for k, (f, g) in enumerate(zip(net.filters, g_filters))]
            net.biases = [adam(f"b{k}", b, g, lr) for k, (b, g) in enumerate(zip(net.biases, g_bias))]
            net.out = adam("out", net.out, g_out + 1e-4 * net.out, lr)
            net.shift = float(adam("shift", np.array(net.shift), np.array(g_shift), lr))
            touched = np.flatnonzero(np.abs(g_rows[:-1]).sum(axis=1))
            if len(touched):  # plain steps for the sparse rows
                near, n = _lists(flat, starts, used[touched])
                np.add.at(net.grams, near, -20 * lr * np.repeat(g_rows[touched] / n[:, None], n, axis=0))


CUTS = np.linspace(0.5, 0.9, 41)


def _set_threshold(net: Convnet, lang: str | None, counts: np.ndarray, least: int) -> None:
    """``counts[label, i]``: the rows whose scores reach the first ``i`` cuts."""
    if counts.sum(axis=1).min() < least:
        return
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + counts[1].sum())
    net.thresholds[lang] = round(float(np.median(CUTS[f1 >= f1.max() - 1e-9])), 3)


def calibrate(net: Convnet, scores: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = 15) -> None:
    """Set each language's threshold: the middle of the best-F1 cut among the
    scores, within 0.5 to 0.9."""
    for lang in set(langs):
        mine = np.array([x == lang for x in langs])
        at = np.searchsorted(CUTS, scores[mine], side="right")
        counts = np.stack([np.bincount(at[labels[mine] == t], minlength=len(CUTS) + 1) for t in (0, 1)])
        _set_threshold(net, lang, counts, least)


def held_out(doc_id: Column) -> Column:
    """The rows that no classifier may learn from."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def with_label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may be learned from (doc_id, text, lang) and
    their label ``toxic``. Always a join by shuffle: labels grow with the texts,
    so a broadcast would end at some size, and disk jump there."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("_want")).agg(F.max("toxic").cast("int").alias("toxic")))
    rows = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.join(known.hint("merge"), F.col("doc_id") == F.col("_want")).drop("_want")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of :func:`with_label` (text, lang, toxic, doc_id, _rid),
    written; ``judge`` marks the fifth of the ids that calibrates, none if a
    label had no other rows."""
    judge = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic-judge")), F.lit(5)) == 0
    rows = with_label(docs, labels).select("doc_id", "text", "lang", "toxic", judge.alias("judge"))
    rows = written(with_row_key(rows), "toxic-rows")
    n = {(r.toxic, r.judge) for r in rows.select("toxic", "judge").distinct().collect()}
    return rows if all((t, False) in n for t, _ in n) else rows.withColumn("judge", F.lit(False))


def _held(batches, texts: int = 2000, most: int = 4 << 20):
    """(texts, labels) of a task's rows, a bounded part at a time (a text of
    more than ``most`` characters is one)."""
    held, labels, size = [], [], 0
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic")):
            held.append(text.as_py())
            labels.append(label.as_py())
            size += len(held[-1] or "")
            if len(held) >= texts or size >= most:
                yield held, np.array(labels, dtype=np.int64)
                held, labels, size = [], [], 0
    if held:
        yield held, np.array(labels, dtype=np.int64)


def bucket_odds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The buckets' log odds and the number of texts by label, over all
    ``rows`` (text, toxic)."""
    def run(batches):
        seen, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for held, y in _held(batches):
            seen += _seen(*_bucketed(held), y)
            texts += np.bincount(y, minlength=2)
        table = np.concatenate([seen, texts[:, None]], axis=1)  # the last column: texts
        i, j = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(table[i, j])], names=["toxic", "bucket", "n"])

    table = np.zeros((2, BUCKETS + 1), np.int64)
    counted = rows.select("text", "toxic").mapInArrow(run, "toxic int, bucket int, n long")
    for r in counted.groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).collect():  # a row per label and bucket
        table[r.toxic, r.bucket] = r.n
    return _odds(table[:, :-1], table[:, -1]), table[:, -1]


def _arrays(net: Convnet) -> dict[str, np.ndarray]:
    """The parameters, by name, as copies."""
    out = {"grams": net.grams.copy(), "out": np.array(net.out), "shift": np.array([net.shift])}
    for k, (f, b) in enumerate(zip(net.filters, net.biases)):
        out[f"filter{k}"], out[f"bias{k}"] = f.copy(), b.copy()
    return out


def _with_arrays(net: Convnet, p: dict[str, np.ndarray]) -> Convnet:
    wide = range(len(WIDTHS))
    return Convnet(p["grams"], [p[f"filter{k}"] for k in wide], [p[f"bias{k}"] for k in wide], p["out"], float(p["shift"][0]), dict(net.thresholds))


def refine(net: Convnet, rows: DataFrame, texts: np.ndarray, rate: float = 0.003, batch: int = 48) -> Convnet:
    """``net`` after training on all ``rows`` (text, toxic), whole texts; of
    each label there are ``texts``. Every partition goes on from ``net`` through
    its rows; the changes are averaged, weighted by rows, a bucket's vector over
    the partitions that moved it."""
    weight, before = texts.sum() / (2 * np.maximum(texts, 1)), _arrays(net)

    def run(batches):
        mine, seen, state, rng = _with_arrays(net, {k: v.copy() for k, v in before.items()}), 0, {}, np.random.default_rng(11)
        for held, y in _held(batches):
            _descend(mine, *_bucketed(held), y, weight[y], rng, state, 1, batch, rate)
            seen += len(y)
        if seen:
            yield from moves(before, _arrays(mine), seen)

    after = _arrays(net)
    averaged(after, rows.select("text", "toxic").mapInArrow(run, SCHEMA), ("grams",))
    return _with_arrays(net, after)


def set_thresholds(net: Convnet, rows: DataFrame, least: int = 15) -> None:
    """:func:`calibrate` on all ``rows`` (text, lang, toxic): tasks count the
    scores between the cuts."""
    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            if len(batch):
                score = net.score(np.array([scorer.pooled(t.as_py()) for t in batch.column("text")]))
                at = np.searchsorted(CUTS, score, side="right")
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(at, pa.int32())], names=["lang", "toxic", "at"])

    found: dict[str | None, np.ndarray] = {}
    places = rows.select("text", "lang", "toxic").mapInArrow(run, "lang string, toxic int, at int")
    for r in places.groupBy("lang", "toxic", "at").agg(F.count(F.lit(1)).alias("n")).collect():  # labels x cuts rows a language
        found.setdefault(r.lang, np.zeros((2, len(CUTS) + 1), np.int64))[r.toxic, r["at"]] = r.n
    for lang, counts in found.items():
        _set_threshold(net, lang, counts, least)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_bytes: int = 32 << 20) -> Convnet:
    """Train on all labelled documents that :func:`held_out` leaves; a fifth of
    them sets the thresholds instead. The training sets out from at most four
    fifths of ``max_rows`` of them of ``max_bytes`` altogether, half of them
    toxic if there are so many, drawn by a hash of the id. Texts are read whole;
    in the start, very long ones come after the others (see
    :func:`sample_of_texts`). A start that lost a label is an error."""
    every = labelled(docs, labels)
    rows = every.filter(~F.col("judge"))
    odds, texts = bucket_odds(rows)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    half = [rows.filter(F.col("toxic") == t).select("_rid", order.alias("_o")).orderBy("_o", "_rid").limit(max_rows * 2 // 5) for t in (0, 1)]
    drawn = written(half[0].unionByName(half[1]).select(F.col("_rid").alias("_want")), "toxic-sample")
    drawn = rows.join(drawn, F.col("_rid") == F.col("_want")).select("doc_id", "text", "toxic")
    start = sample_of_texts(drawn, F.md5(F.col("doc_id").cast("string")), max_bytes, by="toxic")
    wanted, got = [t for t in (0, 1) if texts[t]], sorted({r.toxic for r in start})
    if got != wanted:
        raise ValueError(f"labelled documents have {wanted} as toxic, the drawn sample only {got}")
    net = train([r.text for r in start], [r.toxic for r in start], odds=odds)
    if len(wanted) == 2:
        net = refine(net, rows, texts)
        set_thresholds(net, every.filter("judge"))
    drop_written(every)
    return net


class Scorer:
    """Scores texts in a task; keeps words' projections between texts."""

    def __init__(self, net: Convnet, keep: int = 60_000):
        self.net, self.keep = net, keep
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((1024, FILTERS * sum(WIDTHS)), np.float32)

    def _ids(self, tokens: list[bytes]) -> np.ndarray:
        get = self.number.get
        ids = np.array([get(w, -1) for w in tokens], dtype=np.int64)
        if len(ids) and ids.min() < 0:
            new = list({tokens[k] for k in np.flatnonzero(ids < 0)})
            if len(self.number) + len(new) > self.keep:
                self.number, new = {}, list(set(tokens))
            at = len(self.number)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for lo in range(0, len(new), 20_000):  # bounded scratch
                part = new[lo:lo + 20_000]
                self.rows[at + lo:at + lo + len(part)] = self.net.project(self.net.embed(*gram_buckets(part)))
            self.number.update(zip(new, range(at, at + len(new))))
            ids = np.array([self.number[w] for w in tokens], dtype=np.int64)
        return ids

    def pooled(self, text: str | None) -> np.ndarray:
        ids = self._ids(words(text))  # may move the rows
        ahead, at, best = max(WIDTHS) - 1, 0, None
        while at + PIECE + ahead < len(ids):  # a long text, piece by piece, with what the widest filter reads on
            part = self.net.pooled(self.rows[ids[at:at + PIECE + ahead]], pad=False)
            best = part if best is None else np.maximum(best, part)
            at += PIECE
        part = self.net.pooled(self.rows[ids[at:]])
        return part if best is None else np.maximum(best, part)


def scored(docs: DataFrame, net: Convnet, carry: bool = False, name: str = "_score") -> DataFrame:
    """doc_id and lang (with ``carry``, all columns) and the score ``name``."""
    rows = docs if carry else docs.select("doc_id", "lang", "text")
    keep = [f for f in rows.schema if carry or f.name != "text"]
    schema = T.StructType([*keep, T.StructField(name, T.DoubleType())])
    names = [f.name for f in keep]

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            pooled = [scorer.pooled(t.as_py()) for t in batch.column("text")]
            score = net.score(np.array(pooled)) if pooled else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score, pa.float64())],
                                             names=[*names, name])

    return rows.mapInArrow(run, schema)


def _threshold(net: Convnet) -> Column:
    out = F.lit(DEFAULT_THRESHOLD)
    for lang, cut in sorted(net.thresholds.items(), key=str):
        out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(cut)).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 5000) -> DataFrame:
    """One row per document: its score, the fixed 0.7 decision, and the
    threshold and decision calibrated for its language."""
    net = fit(docs, labels, max_rows)
    out = scored(docs, net).withColumn("threshold", _threshold(net))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"), "threshold",
                      (F.col("_score") >= F.col("threshold")).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 5000) -> DataFrame:
    """``docs`` without those at or above their language's threshold."""
    net = fit(docs, labels, max_rows)
    name, = fresh_names(docs, "_score")
    return scored(docs, net, carry=True, name=name).filter(F.col(name) < _threshold(net)).select(*docs.columns)
