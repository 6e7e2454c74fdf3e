"""Mixing sources to target weights with soft domain membership.

A classifier learned from the labelled table gives every document posteriors
over domains (by default language and quality label). Each document i then gets
a rate r_i >= ``least`` - how often it is taken - such that the expected token
total of every domain, sum_i r_i t_i p_ik, meets its target, and rates stay as
even as the targets allow:

    minimise  1/2 (S - T)' M (S - T) + ridge/2 sum_i t_i (r_i - r0)^2,  S_k = sum_i r_i t_i p_ik

by projected gradient: every document moves against its own slope p_i M (S - T)
and is put back to ``least`` if it falls below. M is the inverse of the domains'
Gram matrix sum_i t_i p_i p_i', so domains that overlap, or are rare, converge as
fast as the others; with it a step of length one is always safe. Steps gain
momentum, which is dropped whenever the objective rises. Nothing is kept for a
document: a step is K numbers, and a document's rate follows from its posteriors
by going through the steps so far. One step is one distributed sum of 2K + 1
numbers over the written posteriors. The ridge falls until every domain is within
the tolerance of its own target, or the slopes prove that no rates can reach all
targets; such a miss is warned of and marked in the result.

Taking effect, a document is emitted floor(r_i) times, and once more with the
chance of the rest. A hash of its id and text decides, so the outcome is the
same in every layout; rows equal in both are emitted equally often.

Defined cases: a null text has no tokens and the classifier's prior; labels
that are null are ignored; a null language is a domain of its own; without
labels there is one domain; domains without a target share what the targets
leave by their mass; repeated rows are documents of their own; empty tables
give empty results; other columns are ignored or, in the mixture, passed
through.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, written

BUCKETS = 1 << 12
#: Numbers in one piece of a distributed sum.
SLICE = 4096


def featurise(text: str | None) -> tuple[np.ndarray, int]:
    """Square roots of hashed byte 3-gram and 5-gram shares, and the token
    count. Vectorised over the whole text, piece by piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    n_tokens = len(raw.split())
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(1, len(raw)), 1 << 20):
        b = np.frombuffer(raw[at:at + (1 << 20) + 4], dtype=np.uint8).astype(np.uint32)
        if len(b) >= 5:
            b3 = (b[:-2] * 31 + b[1:-1]) * 31 + b[2:]
            b5 = (b3[:-2] * 31 + b[3:-1]) * 31 + b[4:]
            for h, seed in ((b3, 2654435761), (b5, 2246822519)):
                counts += np.bincount((h * np.uint32(seed)) >> np.uint32(32 - 12), minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32), n_tokens


@dataclass
class Domains:
    """Softmax classifier over domains."""
    names: list[str]
    weights: np.ndarray
    shift: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.shift
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 250, rate: float = 0.3, ridge: float = 1e-5,
          weight: np.ndarray | None = None) -> Domains:
    """Softmax regression by Adam on the whole sample; ``weight``: how many
    rows of the corpus a row of the sample stands for."""
    k = len(names)
    weight = np.ones(len(y)) if weight is None else weight * len(y) / weight.sum()
    prior = np.log(np.bincount(y, weights=weight, minlength=k) + 1.0)
    w, b = np.zeros((BUCKETS, k), np.float32), (prior - prior.max()).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(k, dtype=np.float32)[y]
    share = (weight / max(1, len(x))).astype(np.float32)[:, None]
    for step in range(steps if k > 1 else 0):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (e / e.sum(axis=1, keepdims=True) - hot) * share
        g = x.T @ gap + ridge * w
        b -= 2 * gap.sum(axis=0)
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        lr = rate * (1 - step / steps)
        w -= lr * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.98 ** (step + 1))) + 1e-6)
    return Domains(names, w, b)


def draw(labelled: DataFrame, sizes: dict[str, int], max_rows: int, least: int = 20) -> DataFrame:
    """Of ``labelled`` (_want, _label, _domain), about ``max_rows`` rows by a hash of
    the id, from each domain its share, but ``least`` rows (fewer if the
    domains are so many that these exceed ``max_rows``, one at least) or all it
    has. A hashed thinning leaves a bounded table, in which rows are counted
    off."""
    spark, total = labelled.sparkSession, max(1, sum(sizes.values()))
    least = max(1, min(least, max_rows // max(1, len(sizes))))
    quota = {d: max(least, -(-max_rows * n // total)) for d, n in sizes.items()}
    rows = [(d, quota[d], min(1.0, (2 * quota[d] + 40) / n)) for d, n in sizes.items()]
    quotas = spark.createDataFrame(rows, "_domain string, _quota long, _odds double")
    order = F.xxhash64(F.col("_want").cast("string"), F.lit("mixing"))
    chance = F.shiftrightunsigned(F.xxhash64(F.col("_want").cast("string"), F.lit("mixing-odds")), 11) / float(1 << 53)
    thin = written(labelled.join(F.broadcast(quotas), "_domain").filter(chance < F.col("_odds")).withColumn("_o", order), "mix-thinned")
    counted = thin.withColumn("_n", F.row_number().over(Window.partitionBy("_domain").orderBy("_o", "_want")))
    return counted.filter(F.col("_n") <= F.col("_quota")).select("_want", "_label", "_domain")


def fit_domains(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 3000) -> Domains:
    """Learn the domains ``lang:label``. The domains are those of all labelled
    documents; the classifier learns from about ``max_rows`` of them, drawn by
    domain (see :func:`draw`) and weighted by the rows they stand for; of an
    id's rows in a domain, the one with the least text is read. What
    reaches the driver is a vector of 8 kB per sampled document."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.min(label).cast("string").alias("_label")).withColumnRenamed("doc_id", "_want")
    domain = F.concat_ws(":", F.coalesce("lang", F.lit("?")), "_label")
    labelled = written(docs.select("doc_id", "lang").join(known, F.col("doc_id") == F.col("_want"))
                       .groupBy("_want", "_label", domain.alias("_domain")).agg(F.count(F.lit(1)).alias("_rows")), "mix-labelled")
    found = labelled.groupBy("_domain").agg(F.count(F.lit(1)).alias("ids"), F.sum("_rows").alias("rows")).orderBy("_domain").collect()
    names = [r._domain for r in found] or ["all"]
    drawn = written(draw(labelled, {r._domain: r.ids for r in found}, max_rows), "mix-sample")
    rows = docs.select("doc_id", "lang", "text").join(drawn, (F.col("doc_id") == F.col("_want")) & (domain == F.col("_domain"))).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("_domain").alias("domain"), "text")
    rows = rows.groupBy("doc_id", "domain").agg(F.min("text").alias("text"))  # of repeated ids one row, before they travel

    def featured(batches):
        for batch in batches:
            x = [featurise(t.as_py())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"),
                                              pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())],
                                             names=["doc_id", "domain", "x"])

    got = rows.mapInArrow(featured, "doc_id string, domain string, x binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.domain, bytes(r.x)))
    number = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(got), BUCKETS), np.float32)
    y = np.array([number[r.domain] for r in got], dtype=int)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r.x, np.float16)
    if not got:
        return train(x, y, names)
    stands = np.array([r.rows for r in found]) / np.maximum(1, np.bincount(y, minlength=len(names)))
    return train(x, y, names, weight=stands[y])


def _each(rows: DataFrame, model: Domains, keep: list[str], more: dict[str, T.DataType], values) -> DataFrame:
    """``keep`` columns of ``rows`` and the columns ``more`` that ``values``
    makes of (tokens, posteriors) of up to 256 texts at a time."""
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(c, t) for c, t in more.items()]])

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                got = [featurise(t.as_py()) for t in batch.column("text")]
                tokens = np.array([n for _, n in got], dtype=np.int64)
                new = values(tokens, model.posteriors(np.array([x for x, _ in got])))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=[*keep, *more])

    return rows.mapInArrow(run, schema)


def _key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key")


def with_posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """doc_id, ``_key`` (a hash of the text), ``_tokens`` and ``_post`` of every
    row, written once."""
    kinds = {"_tokens": T.LongType(), "_post": T.ArrayType(T.FloatType())}
    return written(_each(docs.select("doc_id", "text", _key()), model, ["doc_id", "_key"], kinds, lambda n, p: [
        pa.array(n, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float32()))]), "posteriors")


def replay(post: np.ndarray, steps: list[tuple[np.ndarray, float, float]], start: float, least: float,
           block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Rates after ``steps`` (slope by domain, ridge, momentum) and the points
    that the next step starts from; a row depends on its posteriors alone."""
    x, y = np.full(len(post), max(least, start)), np.full(len(post), max(least, start))
    if steps:
        slopes = np.stack([v for v, _, _ in steps], axis=1)
        for at in range(0, len(post), block):
            own = post[at:at + block] @ slopes
            rate = ahead = x[at:at + block]
            for k, (_, ridge, momentum) in enumerate(steps):
                now = np.maximum(least, ahead - (own[:, k] + ridge * (ahead - start)) / (1 + ridge))
                ahead = now + momentum * (now - rate)
                rate = now
            x[at:at + block], y[at:at + block] = rate, ahead
    return x, y


@dataclass
class Mixture:
    names: list[str]
    targets: np.ndarray
    steps: list[tuple[np.ndarray, float, float]]
    reached: np.ndarray
    metric: np.ndarray
    ridge: float
    start: float
    least: float
    #: Which domains' targets are reached within the tolerance, and whether
    #: it is proved that no rates reach all of them.
    met: np.ndarray
    infeasible: bool

    def rates(self, post: np.ndarray) -> np.ndarray:
        return replay(np.asarray(post, dtype=np.float64), self.steps, self.start, self.least)[0]


def default_targets(mass: np.ndarray, power: float, least: float) -> np.ndarray:
    """Flattened shares: each domain's share to the ``power``, scaled to the
    corpus's own total, or so that no domain must fall below ``least``."""
    share = np.where(mass > 0, np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9), 0) ** power
    share = share / max(share.sum(), 1e-9)
    need = (mass * least / np.maximum(share, 1e-9))[mass > 0].max(initial=0)
    return share * max(mass.sum(), need)


def total_of(rows: DataFrame, k: int, values) -> np.ndarray:
    """Sum over all rows of ``values(tokens, posteriors)``, any count of
    numbers: partitions' sums travel in pieces, which tasks add up."""
    def run(batches):
        total = None
        for batch in batches:
            t = np.asarray(batch.column("_tokens"), dtype=np.float64)
            p = np.asarray(batch.column("_post").flatten(), dtype=np.float64).reshape(-1, k)
            if len(t):
                now = values(t, p).ravel()
                total = now if total is None else total + now
        if total is not None:
            parts = [total[at:at + SLICE] for at in range(0, len(total), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([v.tobytes() for v in parts], pa.binary())],
                                             names=["part", "v"])

    def add(batches):  # sorted, so sums are the same in every run
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column("part").to_pylist(), batch.column("v").to_pylist()):
                held[part] = held.get(part, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                         names=["part", "v"])

    schema = "part int, v binary"
    parts = rows.select("_tokens", "_post").mapInArrow(run, schema).repartition("part").sortWithinPartitions("part", "v")
    got = sorted(parts.mapInArrow(add, schema).collect(), key=lambda r: r.part)
    if not got:
        return values(np.zeros(0), np.zeros((0, k))).ravel()
    return np.concatenate([np.frombuffer(r.v) for r in got])


def fit_rates(rows: DataFrame, model: Domains, shares: dict[str, float] | None = None, power: float = 0.7,
              least: float = 0.0, ridge: float = 1e-3, steps: int = 300, tolerance: float = 2e-3) -> Mixture:
    """Fit the rates of ``rows`` (of :func:`with_posteriors`). ``shares``:
    target share of the corpus's total by domain. The ridge falls until every
    domain is within ``tolerance`` of its *own* target, or until the slopes
    prove that no rates can reach all targets; the latter, or ``steps`` passes
    over the rows without either, is warned of and marked in the result."""
    k = len(model.names)
    if unknown := sorted(set(shares or {}) - set(model.names)):
        raise ValueError(f"shares of unknown domains: {', '.join(unknown)}")
    mass = total_of(rows, k, lambda t, p: t @ p)
    gram = total_of(rows, k, lambda t, p: (p * t[:, None]).T @ p).reshape(k, k)
    if shares:
        named = np.array([shares.get(n, -1.0) for n in model.names])
        rest = max(0.0, 1 - named[named >= 0].sum())
        free = np.where(named < 0, mass, 0)
        targets = np.where(named >= 0, named, rest * free / max(free.sum(), 1e-9)) * mass.sum()
    else:
        targets = default_targets(mass, power, least)
    unit = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-12 * max(np.trace(gram), 1e-9)))
    metric = unit[:, None] * np.linalg.inv(unit[:, None] * gram * unit[None] + 1e-9 * np.eye(k)) * unit[None]
    near = tolerance * np.maximum(targets, 1e-6 * max(mass.sum(), 1))
    start = float(targets.sum() / max(mass.sum(), 1e-9))
    path: list[tuple[np.ndarray, float, float]] = []

    def look():
        """The domains' totals under the rates and at the next step's start,
        and how uneven the rates are."""
        done = list(path)

        def values(t, p):
            x, y = replay(p, done, start, least)
            return np.concatenate([(x * t) @ p, (y * t) @ p, [(t * (x - start) ** 2).sum()]])
        got = total_of(rows, k, values)
        return got[:k], got[k:2 * k], got[2 * k]

    def proved(slope) -> bool:
        """Farkas: whether no rates >= ``least`` come within the tolerance
        of all targets, as no document pays less than ``low``."""
        if not slope.any():
            return False
        lows = rows.select("_post").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([float((np.asarray(
            b.column("_post").flatten(), dtype=np.float64).reshape(-1, k) @ slope).min())])], names=["low"])
            for b in batches if len(b)), "low double")
        low = min(0.0, lows.agg(F.min("low")).first()[0] or 0.0)
        worth = (targets - least * mass) @ slope + near @ np.abs(slope)
        return bool(worth < low * max(0.0, targets.sum() + near.sum() - least * mass.sum()))

    soft, speed, infeasible, values = ridge, 1.0, False, []
    while True:
        reached, ahead, spread = look()
        met = np.abs(reached - targets) <= near
        if met.all() or len(path) >= steps:
            break
        gap = reached - targets
        values.append(gap @ metric @ gap / 2 + soft * spread / 2)
        if len(values) > 1 and values[-1] > values[-2]:  # too far: go on from the rates themselves
            v, held, _ = path[-1]
            path[-1], ahead, speed = (v, held, 0.0), reached, 1.0
        if len(values) > 8 and values[-8] - values[-1] <= 1e-4 * abs(values[-1]):  # settled short of the targets
            infeasible = proved(metric @ gap)
            if infeasible or soft < 1e-10:
                break
            soft, speed, values = soft / 10, 1.0, []
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        path.append((metric @ (ahead - targets), soft, (speed - 1) / faster))
        speed = faster
    if not met.all():
        missed = ", ".join(f"{n}: {r:.6g} of {t:.6g}" for n, r, t, ok in zip(model.names, reached, targets, met) if not ok)
        warnings.warn(f"targets {'that no rates can reach together' if infeasible else f'not reached in {len(path)} steps'}: {missed}")
    return Mixture(model.names, targets, path, reached, metric, soft, start, least, met, infeasible)


def with_rates(rows: DataFrame, mix: Mixture) -> DataFrame:
    """``rows`` of :func:`with_posteriors` with ``_rate``."""
    schema = T.StructType([*rows.schema, T.StructField("_rate", T.DoubleType())])

    def run(batches):
        for batch in batches:
            p = np.asarray(batch.column("_post").flatten(), dtype=np.float64).reshape(-1, len(mix.names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix.rates(p))], names=[*batch.schema.names, "_rate"])

    return rows.mapInArrow(run, schema)


def copies(doc_id: Column, key: Column, rate: Column) -> Column:
    """How often a row is emitted at ``rate``."""
    chance = F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), key, F.lit("copies")), 11) / float(1 << 53)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def _number(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def mixing_table(docs: DataFrame, labels: DataFrame, label: str = "quality", **settings) -> DataFrame:
    """One row per document: its likeliest domain, that posterior, tokens,
    rate and copies, the domain's target and reached totals, and whether its
    target is met."""
    model = fit_domains(docs, labels, label)
    rows = with_posteriors(docs, model)
    mix = fit_rates(rows, model, **settings)
    names = F.array(*[F.lit(n) for n in mix.names])
    best = F.array_position("_post", F.array_max("_post")).cast("int")
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), best)
    return with_rates(rows, mix).select(
        "doc_id", F.element_at(names, best).alias("domain"), _number(F.array_max("_post")).alias("posterior"),
        F.col("_tokens").alias("n_tokens"), _number(F.col("_rate")).alias("rate"), copies(F.col("doc_id"), F.col("_key"), F.col("_rate")).alias("copies"),
        at(mix.targets).alias("domain_target"), at(mix.reached).alias("domain_reached"),
        F.element_at(F.array(*[F.lit(bool(m)) for m in mix.met]), best).alias("domain_met"))


def mixed(docs: DataFrame, labels: DataFrame, label: str = "quality", **settings) -> DataFrame:
    """``docs`` with every row repeated as often as its rate says. The rates
    are fitted on the narrow table of posteriors; the texts are then read once
    more, and each row's rate computed beside it, rather than copied or joined."""
    model = fit_domains(docs, labels, label)
    mix = fit_rates(with_posteriors(docs, model), model, **settings)
    rate, many, one = fresh_names(docs, "_rate", "_copies", "_copy")
    rated = _each(docs, model, docs.columns, {rate: T.DoubleType()}, lambda n, p: [pa.array(mix.rates(p.astype(np.float32)))])
    return (rated.withColumn(many, copies(F.col("doc_id"), _key(), F.col(rate))).filter(F.col(many) > 0)
            .withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many)))).select(*docs.columns))
