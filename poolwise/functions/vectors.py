"""Vector column functions over ``ARRAY<DOUBLE>``.

Written with Spark's higher-order functions so they run in the JVM; no Python
is involved. Reductions fold left to right, which is also the order DuckDB's
``list_inner_product`` uses, so dot products agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# torch.nn.functional.cosine_similarity default eps
COSINE_EPS = 1e-8
# entropy smoothing term used by the uncertainty score
ENTROPY_EPS = 1e-10


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(x, y) -> Column:
    """Left-to-right sum of products."""
    return _dot(_c(x), _c(y))


def _dot(x: Column, y: Column) -> Column:
    prod = F.zip_with(x, y, lambda a, b: a * b)
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x, y, nx=None, ny=None) -> Column:
    """``x.y / max(|x||y|, eps)``; pass precomputed norms to avoid recomputing."""
    nx = norm(x) if nx is None else _c(nx)
    ny = norm(y) if ny is None else _c(ny)
    return dot(x, y) / F.greatest(nx * ny, F.lit(COSINE_EPS))


def softmax(logits) -> Column:
    l = _c(logits)
    m = F.array_max(l)
    ex = F.transform(l, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def entropy(probs) -> Column:
    """``-sum(p * ln(p + 1e-10))``, natural log."""
    t = F.transform(_c(probs), lambda p: p * F.log(p + F.lit(ENTROPY_EPS)))
    return -F.aggregate(t, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def argmax(logits) -> Column:
    """Index of the largest value; ties go to the lowest index."""
    l = _c(logits)
    return (F.array_position(l, F.array_max(l)) - 1).cast("int")


def relu(x) -> Column:
    return F.transform(_c(x), lambda v: F.greatest(v, F.lit(0.0)))
