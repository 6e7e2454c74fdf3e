"""Language-model scores: a causal self-attention model over subword ids.

A text is its words, lower-cased, then one end. Each word is spelled in the
ids of a public byte-level tokenizer (``SPACE`` in front of it marks where it
starts), so any text has a probability. The model reads a window of ids: their
embeddings plus a position vector, one head of masked attention, a ReLU layer
with a skip; the next id is coded by the yes/no decisions on the way to it in a
binary tree over the ids. Each decision is a logistic of the state, so
probabilities sum to one without a sum over the vocabulary, and an id costs
about as many decisions as it has bits.

* The tree comes from the corpus: the biases are the exact log odds of the id
  counts over *all* training texts. Ids are arranged by what they follow in all
  of them (:func:`neighbourhoods`), so near leaves behave alike.
* Attention and embeddings are trained in numpy by Adam, data-parallel on *all*
  training texts (:func:`refine`). Where the tasks set out from is a model
  trained on a bounded sample (``sample_words``; a hash of the id chooses).
* Long texts are scored in overlapping windows: every window after the first
  re-reads ``LENGTH - STRIDE`` ids as context and scores the rest, so each id is
  scored exactly once. Windows are batched.

The base score is an exact unigram score over all training words. The
``common`` most frequent words go to the tasks as a table of that size; all
other words' counts are joined, per document and word.

Defined cases: a null text is empty (only the end is scored); null ids belong
to the training rows; without training rows the base counts are zero and
the model is untrained; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .averaging import SCHEMA, averaged, moves
from .common import arrow_rows, python_values, sample_of_texts, with_row_key, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = 50256
IDS = END + 1
DIM, HIDDEN, LENGTH, STRIDE = 16, 24, 32, 28
#: Texts that a task takes up at once.
ROWS = 1024
#: Nodes of the tree that are computed for every state at once.
TOP = 64
#: Stands for the end among the words; no word can be it.
END_WORD = "\n"
SPACE = b" "


class Speller:
    """Words to ids; keeps what it has spelled, of more than ``keep`` words the
    earlier half (frequent words are met early)."""

    def __init__(self, path: str, keep: int = 200_000):
        import tiktoken

        import public_tokenizers as P

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.keep, self.generation = keep, 0
        self.clear()

    def clear(self):
        self.generation += 1
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.int32), 0

    def shrink(self) -> None:
        """Forget the later half of the words."""
        self.generation += 1
        n = len(self.words) // 2
        self.words = self.words[:n]
        self.number = {w: k for k, w in enumerate(self.words)}
        self.used = int(self.lengths[:n].sum())

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the kept table."""
        get = self.number.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            if len(self.number) > self.keep:
                self.shrink()
            for w in words:
                if w not in self.number:
                    self._add(w)
            out = [self.number[w] for w in words]
        return np.array(out, dtype=np.int64)

    def _add(self, word: bytes) -> None:
        ids = self.encoding.encode_ordinary((SPACE + word).decode("utf-8", "replace"))
        k = len(self.words)
        if k == len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[k], self.lengths[k] = self.used, len(ids)
        self.used += len(ids)
        self.number[word] = k
        self.words.append(word)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered words, then the end."""
        n = self.lengths[numbers]
        total = int(n.sum())
        at = np.repeat(self.starts[numbers] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(total)
        return np.concatenate([self.flat[at], [END]]).astype(np.int32)


def words(text: str | None) -> list[bytes]:
    """Bytes lower-case A-Z only, and split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """:func:`words` of many texts at once: where each text's words begin, the
    words as codes, and the coded words."""
    starts, codes, names = coded(texts)
    return starts, codes, python_values(names.cast(pa.large_binary()))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As :func:`coded_words`, with the coded words as an Arrow array."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a slice's buffers start elsewhere, which the splitting gets wrong
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    starts, flat = np.asarray(lists.offsets, dtype=np.int64), lists.flatten()
    starts = starts - starts[0]
    found = flat.dictionary_encode()
    codes, names = np.asarray(found.indices, dtype=np.int64), found.dictionary
    empty = np.asarray(pc.equal(names, ""), dtype=bool)  # white space at an end leaves an empty word
    if empty.any():
        keep = ~empty[codes]
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return starts, codes, names


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers as P

    return str(P.path(name))


# -- the tree ---------------------------------------------------------------

@dataclass
class Tree:
    """Paths in one flat table: id i decides at ``node[start[i]:start[i + 1]]``,
    towards ``sign`` (+1 or -1)."""
    start: np.ndarray
    node: np.ndarray
    sign: np.ndarray
    bias: np.ndarray


def build_tree(weights: np.ndarray, place: np.ndarray) -> Tree:
    """A binary tree over the ids that halves the weight at every node, along
    the direction in which ``place`` (a vector per id) varies most there."""
    n = len(weights)
    paths: list[list[int]] = [[] for _ in range(n)]
    signs: list[list[int]] = [[] for _ in range(n)]
    bias: list[float] = []
    used: list[float] = []
    todo = [np.arange(n)]
    while todo:
        group = todo.pop()
        if len(group) < 2:
            continue
        w, x = weights[group], place[group]
        spread = (w[:, None] * (x - (w[:, None] * x).sum(0) / w.sum()) ** 2).sum(0)
        order = np.lexsort((group, -w, x[:, spread.argmax()])) if spread.max() > 1e-12 * w.sum() else np.lexsort((group, -w))
        mass = np.cumsum(w[order])
        cut = int(np.clip(np.searchsorted(mass, mass[-1] / 2, side="left") + 1, 1, len(group) - 1))
        if cut > 1 and abs(mass[cut - 2] - mass[-1] / 2) < abs(mass[cut - 1] - mass[-1] / 2):
            cut -= 1
        node = len(bias)
        bias.append(float(np.log(mass[cut - 1] / (mass[-1] - mass[cut - 1]))))
        used.append(float(mass[-1]))
        for side, part in ((1, group[order[:cut]]), (-1, group[order[cut:]])):
            for i in part:
                paths[i].append(node)
                signs[i].append(side)
            todo.append(part)
    length = np.array([len(p) for p in paths])
    by_use = np.argsort(-np.array(used), kind="stable")  # number 0 is the root, the rarest nodes come last
    number = np.empty(len(bias), dtype=np.int32)
    number[by_use] = np.arange(len(bias))
    return Tree(np.concatenate([[0], np.cumsum(length)]).astype(np.int32),
                number[np.array([k for p in paths for k in p], dtype=np.int64)],
                np.array([s for p in signs for s in p], dtype=np.float32), np.array(bias, dtype=np.float32)[by_use])


def neighbourhoods(train_docs: DataFrame, usage: np.ndarray, path: str, context: int = 256, dim: int = 12) -> np.ndarray:
    """A vector per id from what it follows in *all* training texts: the main
    directions of its square-rooted profile over the most frequent ids. Tasks
    count (id, frequent id before it); the tables have at most ids x context
    rows, and of them only a context x context matrix and the vectors reach the
    driver."""
    name, size = os.path.basename(path), len(usage)
    top = np.argsort(-usage, kind="stable")[:context]
    slot = np.full(size + 1, -1)  # the last one stands between texts
    slot[top] = np.arange(len(top))

    def follow(batches):
        speller = Speller(path if os.path.exists(path) else tokenizer_path(name))
        row, used, table = np.full(size, -1), 0, np.zeros((size, context), np.int64)  # rows take memory as they are used
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            starts, codes, names = coded_words(batch.column("text"))
            numbers = speller.numbers(names)
            seq = np.concatenate([x for a, b in zip(starts, starts[1:])
                                  for x in ([size, size, size, END], speller.ids(numbers[codes[a:b]]))])
            new = np.unique(seq[(seq < size)])
            new = new[row[new] < 0]
            row[new] = used + np.arange(len(new))
            used += len(new)
            for gap, weight in ((1, 6), (2, 3), (3, 2)):  # one over the gap, in sixths
                a, b = slot[seq[:-gap]], seq[gap:]
                both = (a >= 0) & (b < size)
                np.add.at(table.ravel(), row[b[both]] * context + a[both], weight)
        ids = np.flatnonzero(row >= 0).astype(np.int32)
        for at in range(0, len(ids), 256):
            part = table[row[ids[at:at + 256]]]
            i, j = np.nonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + 256][i]), pa.array(j.astype(np.int32)), pa.array(part[i, j])],
                                             names=["id", "slot", "n"])

    pairs = train_docs.select("text").mapInArrow(follow, "id int, slot int, n long").groupBy("id", "slot").agg(F.sum("n").alias("n"))
    profiles = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("p"))  # at most ``context`` entries
    profiles = written(profiles.repartition(16, "id").sortWithinPartitions("id"), "lm-profiles")

    def shares(batch):
        ids, lists = batch.column("id").to_numpy(), batch.column("p")
        flat, table = lists.flatten(), np.zeros((len(ids), context), np.float32)
        owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        table[owner, flat.field("slot").to_numpy()] = flat.field("n").to_numpy() / 6
        return ids, np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 5))

    def spread(batches):
        first, out = None, np.zeros((context, context))
        for ids, share in map(shares, batches):
            if len(ids):
                weighted = share * np.sqrt(usage[ids])[:, None]
                first, out = int(ids[0]) if first is None else first, out + weighted.T @ weighted
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["id", "v"])

    parts = sorted(profiles.mapInArrow(spread, "id int, v binary").collect())  # a matrix per file
    out = np.zeros((size, dim), np.float32)
    if not parts:
        return out
    _, vectors = np.linalg.eigh(sum(np.frombuffer(r.v).reshape(context, context) for r in parts))
    main = vectors[:, ::-1][:, :dim].astype(np.float32)

    def placed(batches):
        for ids, share in map(shares, batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((share @ main).tolist(), pa.list_(pa.float32()))], names=["id", "v"])

    for r in profiles.mapInArrow(placed, "id int, v array<float>").collect():  # at most one row per id
        out[r.id] = r.v
    return out


# -- the model --------------------------------------------------------------

@dataclass
class Model:
    tree: Tree
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tree: Tree, seed: int = 3) -> "Model":
        rng = np.random.default_rng(seed)

        def normal(*shape, scale=0.1):
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(tree, {
            "embed": normal(IDS, DIM), "place": normal(LENGTH, DIM, scale=0.05), "q": normal(DIM, DIM), "k": normal(DIM, DIM),
            "v": normal(DIM, DIM, scale=0.2), "w1": normal(2 * DIM, HIDDEN, scale=0.2), "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, DIM, scale=0.2), "skip": np.eye(DIM, dtype=np.float32),
            "near": np.zeros((LENGTH, LENGTH), np.float32), "node": np.zeros((len(tree.bias), DIM), np.float32),
            "bias": tree.bias.copy()})

    def states(self, x_ids: np.ndarray) -> tuple[np.ndarray, dict]:
        """States (windows, positions, DIM) from which the next ids are coded;
        x_ids (windows, positions) are the ids before them."""
        p, n = self.p, x_ids.shape[1]
        x = p["embed"][x_ids]
        y = x + p["place"][:n]
        q, k, v = y @ p["q"], y @ p["k"], x @ p["v"]
        score = q @ k.transpose(0, 2, 1)
        score *= np.float32(1 / np.sqrt(DIM))
        score += self._mask(n)
        np.exp(score, out=score)  # scores are small; the mask makes what is ahead zero
        score /= score.sum(-1, keepdims=True)
        a = score @ v
        joined = np.concatenate([x, a], axis=-1)
        raw = joined @ p["w1"] + p["b1"]
        hidden = np.maximum(raw, 0)
        out = hidden @ p["w2"] + x @ p["skip"]
        return out, {"x": x, "y": y, "q": q, "k": k, "v": v, "att": score, "joined": joined, "raw": raw, "hidden": hidden}

    def _mask(self, n: int) -> np.ndarray:
        ahead = np.triu(np.ones((n, n), bool), 1)
        return np.where(ahead, np.float32(-np.inf), np.clip(self.p["near"][:n, :n], -20, 20))

    def decisions(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For flat targets: which state, which node, which sign."""
        lo = self.tree.start[targets]
        n = self.tree.start[targets + 1] - lo
        row = np.repeat(np.arange(len(targets)), n)
        at = np.arange(len(row)) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return row, self.tree.node[at], self.tree.sign[at]

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target from its state."""
        row, node, sign = self.decisions(targets)
        z = np.einsum("ij,ij->i", np.take(states, row, axis=0), np.take(self.p["node"], node, axis=0))
        z += self.p["bias"][node]
        return -np.bincount(row, weights=_cost(z, sign), minlength=len(targets))


def _cost(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Cost of decisions with logits ``z``; overwrites it."""
    z *= -sign
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    z += 1
    return np.log(z, out=z)


class Reader:
    """A trained model laid out for scoring: weights that meet the same input
    are one matrix, only scored positions are carried to the end, and the nodes
    that are used most are computed by one product for all states."""

    def __init__(self, model: Model):
        self.model, p = model, model.p
        tree = model.tree
        often = tree.node < TOP
        owner = np.repeat(np.arange(len(tree.start) - 1), np.diff(tree.start))
        self.paths = []
        for part in (often, ~often):
            start = np.concatenate([[0], np.cumsum(np.bincount(owner[part], minlength=len(tree.start) - 1))])
            self.paths.append((start, tree.node[part].astype(np.int64), tree.sign[part]))
        self.top = np.ascontiguousarray(p["node"][:TOP].T)
        self.into = np.concatenate([p["q"] / np.float32(np.sqrt(DIM)), p["k"], p["v"] @ p["w1"][DIM:], p["w1"][:DIM], p["skip"]], axis=1)
        at = np.zeros((LENGTH, self.into.shape[1]), np.float32)
        at[:, :2 * DIM] = p["place"] @ self.into[:, :2 * DIM]  # places are part of queries and keys only
        at[:, 2 * DIM + HIDDEN:2 * DIM + 2 * HIDDEN] = p["b1"]
        self.at, self.mask = at, model._mask(LENGTH)

    def states(self, x_ids: np.ndarray, first: int) -> np.ndarray:
        """States of the positions from ``first`` on, flat."""
        p = self.model.p
        z = (np.take(p["embed"], x_ids.ravel(), axis=0) @ self.into).reshape(*x_ids.shape, -1)
        z += self.at
        q, k, v = z[:, first:, :DIM], z[:, :, DIM:2 * DIM], z[:, :, 2 * DIM:2 * DIM + HIDDEN]
        score = np.matmul(q, k.transpose(0, 2, 1))
        score += self.mask[first:]
        np.exp(score, out=score)
        raw = np.matmul(score, v)
        raw /= score.sum(-1, keepdims=True)
        raw += z[:, first:, 2 * DIM + HIDDEN:2 * DIM + 2 * HIDDEN]
        np.maximum(raw, 0, out=raw)
        out = raw.reshape(-1, HIDDEN) @ p["w2"]
        out += z[:, first:, 2 * DIM + 2 * HIDDEN:].reshape(-1, DIM)
        return out

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """As :meth:`Model.log_probs`."""
        p, total = self.model.p, None
        for k, (start, nodes, signs) in enumerate(self.paths):
            lo = start[targets]
            n = start[targets + 1] - lo
            row = np.repeat(np.arange(len(targets)), n)
            at = np.repeat(lo - np.cumsum(n) + n, n)
            at += np.arange(len(row))
            node = nodes[at]
            if k == 0:
                every = states @ self.top
                every += p["bias"][:self.top.shape[1]]
                z = every.ravel()[row * self.top.shape[1] + node]
            else:
                z = np.einsum("ij,ij->i", np.take(states, row, axis=0), np.take(p["node"], node, axis=0))
                z += p["bias"][node]
            cost = np.bincount(row, weights=_cost(z, signs[at]), minlength=len(targets))
            total = cost if total is None else total + cost
        return -total


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's ids: inputs (windows, LENGTH), targets, and which targets
    the window scores. Padding repeats the end and is never scored."""
    n = len(ids)
    count = 1 + max(0, -(-(n - LENGTH) // STRIDE))
    padded = np.concatenate([[END], ids, np.full(LENGTH + count * STRIDE, END, ids.dtype)])
    at = (np.arange(count) * STRIDE)[:, None] + np.arange(LENGTH)
    scored = (at < n) & ((np.arange(LENGTH) >= LENGTH - STRIDE) | (at[:, :1] == 0))
    return padded[at], padded[at + 1], scored


def score_ids(model: Model, docs: list[np.ndarray], batch: int = 64) -> np.ndarray:
    """Log10 probability of each text's ids. Windows of all texts are scored
    in batches; a text's first window is scored from its start, the others from
    where the one before ends."""
    reader, total = Reader(model), np.zeros(len(docs))

    def flush(held: list[tuple], first: int) -> None:
        x, y, m = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        owner = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        for at in range(0, len(x), batch):
            part = slice(at, at + batch)
            mask = m[part, first:]
            states = reader.states(x[part], first)[mask.ravel()]
            logs = reader.log_probs(states, y[part, first:][mask])
            np.add.at(total, np.repeat(owner[part], mask.sum(1)), logs)

    held: dict[int, list] = {0: [], LENGTH - STRIDE: []}
    size = dict.fromkeys(held, 0)
    for i, ids in enumerate(docs):
        x, y, m = windows(ids)
        for first, part in ((0, slice(0, 1)), (LENGTH - STRIDE, slice(1, None))):
            if len(x[part]):
                held[first].append((i, x[part], y[part], m[part]))
                size[first] += len(x[part])
                if size[first] >= 16 * batch:
                    flush(held[first], first)
                    held[first], size[first] = [], 0
    for first, rest in held.items():
        if rest:
            flush(rest, first)
    return total / np.log(10)


def train(model: Model, docs: list[np.ndarray], steps: int | None = 1500, batch: int = 48, rate: float = 0.006, seed: int = 5) -> None:
    """Adam on random batches of the texts' windows, all positions; without
    ``steps`` on every window once, in random order."""
    parts = [windows(d) for d in docs if len(d)]
    if not parts:
        return
    x_all, y_all, m_all = (np.concatenate([p[k] for p in parts]) for k in range(3))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x_all)) if steps is None else None
    steps = -(-len(x_all) // batch) if steps is None else steps
    p = model.p
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    scale = np.float32(1 / np.sqrt(DIM))
    for step in range(steps):
        pick = rng.integers(0, len(x_all), batch) if order is None else order[step * batch:(step + 1) * batch]
        x_ids, y_ids, mask = x_all[pick], y_all[pick], m_all[pick]
        out, c = model.states(x_ids)
        flat = out[mask]
        row, node, sign = model.decisions(y_ids[mask])
        weighted = np.take(p["node"], node, axis=0)
        z = np.einsum("ij,ij->i", np.take(flat, row, axis=0), weighted) + p["bias"][node]
        slope = (-sign / (1 + np.exp(sign * z)) / len(flat)).astype(np.float32)
        g = {}
        d_flat = np.zeros_like(flat)
        weighted *= slope[:, None]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        d_flat[row[starts]] = np.add.reduceat(weighted, starts, axis=0)
        d_out = np.zeros_like(out)
        d_out[mask] = d_flat
        two = lambda a: a.reshape(-1, a.shape[-1])
        g["w2"] = two(c["hidden"]).T @ two(d_out)
        g["skip"] = two(c["x"]).T @ two(d_out)
        d_x = d_out @ p["skip"].T
        d_raw = (d_out @ p["w2"].T) * (c["raw"] > 0)
        g["b1"] = two(d_raw).sum(0)
        g["w1"] = two(c["joined"]).T @ two(d_raw)
        d_joined = d_raw @ p["w1"].T
        d_x = d_x + d_joined[..., :DIM]
        d_a = d_joined[..., DIM:]
        d_att = d_a @ c["v"].transpose(0, 2, 1)
        d_v = c["att"].transpose(0, 2, 1) @ d_a
        d_score = c["att"] * (d_att - (d_att * c["att"]).sum(-1, keepdims=True))
        g["near"] = d_score.sum(0)
        d_q, d_k = (d_score @ c["k"]) * scale, (d_score.transpose(0, 2, 1) @ c["q"]) * scale
        g["q"], g["k"], g["v"] = two(c["y"]).T @ two(d_q), two(c["y"]).T @ two(d_k), two(c["x"]).T @ two(d_v)
        d_y = d_q @ p["q"].T + d_k @ p["k"].T
        d_x = d_x + d_v @ p["v"].T + d_y
        g["place"] = d_y.sum(0)
        lr = rate * min(1, (step + 1) / 100) * (1 - 0.95 * step / steps)
        fix = np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
        for name, grad in g.items():
            first[name] += 0.1 * (grad - first[name])
            second[name] += 0.01 * (grad * grad - second[name])
            p[name] -= lr * fix * first[name] / (np.sqrt(second[name]) + 1e-8)
        # sparse rows: only what the batch touches moves; gradients are made in the order in which they are summed
        nodes, by_node, node_starts = _by_row(node)
        node_slope = slope[by_node]
        g_node = np.take(flat, row[by_node], axis=0)
        g_node *= node_slope[:, None]
        ids, by_id, id_starts = _by_row(x_ids.ravel())
        for name, rows, grad, starts in (("node", nodes, g_node, node_starts), ("bias", nodes, node_slope, node_starts),
                                         ("embed", ids, np.take(two(d_x), by_id, axis=0), id_starts)):
            summed = np.add.reduceat(grad, starts, axis=0)
            second[name][rows] += 0.05 * (summed * summed - second[name][rows]) + 1e-12
            first[name][rows] += 0.2 * (summed - first[name][rows])
            p[name][rows] -= lr * first[name][rows] / (np.sqrt(second[name][rows]) + 1e-6) * (0.3 if name == "bias" else 1)


def _by_row(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of ``where``, its order by value, and where in that
    order each value begins."""
    order = np.argsort(where.astype(np.uint16), kind="stable")  # ids and nodes fit; sixteen bits are sorted by radix
    ordered = where[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], order, starts


# -- on Spark ---------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all words and ends of ``docs``, written; counted per
    Arrow batch in pieces of ``ROWS`` texts, summed by word."""
    def counts_of(texts):
        _, codes, names = coded(texts)
        words = pa.concat_arrays([names.cast(pa.string()), pa.array([END_WORD])])
        n = np.append(np.bincount(codes, minlength=len(names)), len(texts))
        some = pa.array(np.flatnonzero(n))
        return pa.table([words.take(some), pa.array(n, pa.int64()).take(some)], names=["word", "c"])

    def run(batches):
        for batch in batches:
            if len(batch):
                pieces = [counts_of(batch.column("text").slice(at, ROWS)) for at in range(0, len(batch), ROWS)]
                summed = pa.concat_tables(pieces).group_by("word", use_threads=False).aggregate([("c", "sum")])
                yield from summed.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

    counted = docs.select("text").mapInArrow(run, "word string, c long")
    return written(counted.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words above a count that at most ``most`` words reach, found from
    a histogram of the counts' binary orders of magnitude, eight steps each."""
    step = F.floor(F.log2("c") * 8).cast("int")
    held, least = 0, None
    for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("s")).collect():
        held += r.n
        if held > most:
            break
        least = r.least
    if least is None:
        return {}
    return {r.word.encode(): r.c for r in counts.filter(F.col("c") >= least).collect()}


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id is used, from all word counts: at most one row per
    id reaches the driver."""
    def run(batches):
        speller, seen = Speller(path, keep=0), np.zeros(IDS, np.int64)
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if w == END_WORD:
                    seen[END] += c
                else:
                    np.add.at(seen, speller.encoding.encode_ordinary(" " + w), c)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["id", "c"])

    summed = counts.mapInArrow(run, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(IDS)
    for r in summed:
        out[r.id] = r.c
    return out


def fit(train_docs: DataFrame, counts: DataFrame, path: str, sample_docs: int = 2000, sample_words: int = 1_000_000,
        steps: int = 6000, one_in: int = 1) -> Model:
    """The model: counts, the tree and the parameters from all training texts
    (see :func:`refine`, also for ``one_in``). Only where the parameters set out from is learned from
    at most ``sample_docs`` texts and about ``sample_words`` words of them,
    whole texts, very long ones last (see :func:`sample_of_texts`)."""
    usage = id_counts(counts, path)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("lm"))
    chosen = written(train_docs.select("doc_id", order.alias("_o")).filter("doc_id is not null")
                     .orderBy("_o", "doc_id").limit(sample_docs).select(F.col("doc_id").alias("_want")).distinct(), "lm-sample")
    rows = train_docs.join(chosen, F.col("doc_id") == F.col("_want")).select("doc_id", "text")
    speller, docs, held = Speller(path), [], 0
    for r in sample_of_texts(rows, F.md5(F.col("doc_id").cast("string")), sample_words * 16):
        w = words(r.text)
        docs.append(speller.ids(speller.numbers(w)))
        held += len(w)
        if held > sample_words:
            break
    if not docs and counts.filter(F.col("word") != END_WORD).head(1) and chosen.head(1):
        raise ValueError("there are training texts, but the drawn sample has none")
    model = Model.fresh(build_tree(usage + 0.5, neighbourhoods(train_docs, usage, path)))
    train(model, docs, steps if docs else 0)
    refine(model, train_docs, path, one_in)
    return model


def refine(model: Model, train_docs: DataFrame, path: str, one_in: int = 1, buffer: int = 20_000, rate: float = 0.003,
           batch: int = 192) -> None:
    """Train ``model`` on every window of all training texts, whole (with
    ``one_in``: of one in so many of them). Every partition goes on from the model through its texts,
    ``buffer`` windows at a time; the changes are averaged, weighted by windows,
    an id's and a node's rows over the partitions that moved them."""
    name = os.path.basename(path)

    def run(batches):
        speller = Speller(path if os.path.exists(path) else tokenizer_path(name))
        mine = Model(model.tree, {k: v.copy() for k, v in model.p.items()})
        held, size, seen = [], 0, 0

        def learn():
            train(mine, held, steps=None, batch=batch, rate=rate)

        for rows in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            starts, codes, names = coded_words(rows.column("text"))
            numbers = speller.numbers(names)
            for a, b in zip(starts, starts[1:]):
                ids = speller.ids(numbers[codes[a:b]])
                for at in range(0, len(ids), buffer * STRIDE):  # a very long text in pieces
                    held.append(ids[at:at + buffer * STRIDE])
                    n = 1 + max(0, -(-(len(held[-1]) - LENGTH) // STRIDE))
                    size, seen = size + n, seen + n
                    if size >= buffer:
                        learn()
                        held, size = [], 0
        if held:
            learn()
        if seen:
            yield from moves(model.p, mine.p, seen)

    chosen = train_docs if one_in == 1 else train_docs.filter(
        F.pmod(F.xxhash64("doc_id", "text", F.lit("lm-share")), F.lit(one_in)) == 0)
    averaged(model.p, chosen.select("text").mapInArrow(run, SCHEMA), ("embed", "node", "bias"))


def score(docs: DataFrame, path: str | None = None, common: int = 100_000, **sizes) -> DataFrame:
    """One row per document: the exact unigram score over all training rows
    and the attention model's score."""
    path = path or tokenizer_path()
    name = os.path.basename(path)
    train_docs = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    counts = word_counts(train_docs)
    head = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(head["n"] or 0), int(head["v"])
    frequent = frequent_words(counts, common)
    end_count = frequent.get(END_WORD.encode(), 0) or (counts.filter(F.col("word") == END_WORD).first() or {"c": 0})["c"]
    with arrow_rows(docs.sparkSession, ROWS):
        model = fit(train_docs, counts, path, **sizes)

    def run(batches):
        here = path if os.path.exists(path) else tokenizer_path(name)
        speller, value, generation = Speller(here), np.zeros(0), 1
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            starts, codes, names = coded_words(batch.column("text"))
            numbers = speller.numbers(names)
            if generation != speller.generation:
                value, generation = np.zeros(0), speller.generation
            if len(value) < len(speller.words):
                new = [frequent.get(w) for w in speller.words[len(value):]]
                value = np.concatenate([value, [np.nan if c is None else np.log10(c + 0.5) for c in new]])
            n_docs, n_words = len(batch), np.diff(starts)
            doc = np.repeat(np.arange(n_docs), n_words)
            mine = value[numbers][codes] if len(codes) else np.zeros(0)
            tail = np.isnan(mine)
            known = np.bincount(doc, weights=~tail, minlength=n_docs).astype(np.int64) + (end_count > 0)
            base = np.bincount(doc, weights=np.where(tail, 0, mine), minlength=n_docs) + np.log10(end_count + 0.5)
            pairs, times = np.unique(doc[tail] * max(1, len(names)) + codes[tail], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(n_docs + 1) * max(1, len(names)))
            rare = pa.StructArray.from_arrays([pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(pairs % max(1, len(names)))),
                                               pa.array(times, pa.int64())], names=["word", "k"])
            ids = [speller.ids(numbers[codes[a:b]]) for a, b in zip(starts, starts[1:])]
            arrays = [batch.column("doc_id"), batch.column("_rid"), pa.array(n_words + 1, pa.int64()), pa.array(known, pa.int64()),
                      pa.array(base, pa.float64()), pa.array(score_ids(model, ids), pa.float64()),
                      pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_rid", "n_tokens", "n_known", "base", "score", "rare"])

    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    with arrow_rows(docs.sparkSession, ROWS):
        rows = written(keyed.mapInArrow(run, "doc_id long, _rid long, n_tokens long, n_known long, base double, score double, "
                                        "rare array<struct<word:string,k:bigint>>"), "lm-rows")
    rare = rows.select("_rid", F.explode("rare").alias("r")).select("_rid", "r.word", "r.k")
    rare = rare.join(counts, "word", "left").groupBy("_rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    norm = float(np.log10(n + 0.5 * (v + 1)))
    return rows.drop("rare").join(rare, "_rid", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
