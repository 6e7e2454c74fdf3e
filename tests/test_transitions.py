"""Twin-threshold boundaries against a plain walk over each key."""
import math

import numpy as np
import pytest

from poolwise.operators.transitions import IDLE, Summary, UNIT, _step, shot_transitions

SCHEMA = "key string, pos long, vec array<double>"


def _plain(rows, low, high, rest):
    """One key after another, one frame after another."""
    low, high, out, by = round(low * UNIT), round(high * UNIT), [], {}
    for key, pos, vec in rows:
        by.setdefault(key, []).append((pos, vec))
    for key, frames in by.items():
        frames.sort()
        wait, run = 0, []
        for (_, a), (pos, b) in zip(frames, frames[1:]):
            if a is None or b is None:
                q = 2 * UNIT
            else:
                cos = np.dot(a, b) / max(math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b)), 1e-8)
                q = 2 * UNIT if math.isnan(cos) else int(math.floor((1 - cos) * UNIT + 0.5))
            if wait:
                wait -= 1
            elif q >= high:
                out.append((key, "cut", pos, pos, q))
                wait, run = rest, []
            elif q >= low:
                run.append((pos, q))
            else:
                if sum(x for _, x in run) >= high:
                    out.append((key, "gradual", run[0][0], run[-1][0], sum(x for _, x in run)))
                    wait = rest
                run = []
        if sum(x for _, x in run) >= high:
            out.append((key, "gradual", run[0][0], run[-1][0], sum(x for _, x in run)))
    return sorted(out, key=repr)


def _turning(key, angles, start=0):
    """Frames that turn by the given angles."""
    at = np.cumsum([0.0, *angles])
    return [(key, start + i, [math.cos(a), math.sin(a)]) for i, a in enumerate(at)]


def _got(spark, rows, *args, **kw):
    return sorted((tuple(r) for r in shot_transitions(spark.createDataFrame(rows, SCHEMA), *args, **kw).collect()), key=repr)


def test_summary_is_the_walk_from_every_entry():
    rng = np.random.default_rng(1)
    for _ in range(300):
        low, high, rest = 10, int(rng.integers(10, 40)), int(rng.integers(0, 4))
        steps = rng.choice([0, 5, 12, 25, 39, 60], size=int(rng.integers(1, 12)), p=[0.1, 0.15, 0.4, 0.2, 0.1, 0.05]).tolist()
        one = Summary(low, high, rest)
        for pos, q in enumerate(steps):
            one.add(pos, q)
        for entry in [(w, None, None, 0) for w in range(rest + 1)] + [(0, -9, -2, s) for s in (10, 11, 20, 35, 70)]:
            state = entry
            for pos, q in enumerate(steps):
                state = _step(state, pos, q, low, high, rest)[0]
            assert one.apply(entry) == state


@pytest.mark.parametrize("rest", [0, 3])
def test_hot_key_over_all_partitions_equals_the_plain_walk(spark, rest):
    rng = np.random.default_rng(3)
    rows = _turning("hot", rng.choice([0.02, 0.5, 0.7, 2.0], size=900, p=[0.3, 0.35, 0.25, 0.1]))
    for k in range(12):
        rows += _turning(f"k{k}", rng.choice([0.02, 0.5, 0.7, 2.0], size=20 + k))
    rows += _turning(None, rng.choice([0.02, 0.6, 2.0], size=40))
    want = _plain(rows, 0.1, 1.0, rest)
    assert _got(spark, rows, 0.1, 1.0, rest=rest) == want and len(want) > 40
    assert {r[1] for r in want} == {"cut", "gradual"}


def test_one_run_over_every_partition(spark):
    rows = _turning("a", [0.5] * 600) + _turning("b", [0.02] * 100) + _turning("c", [0.5] * 3)
    got = _got(spark, rows, 0.1, 1.0)
    assert got == _plain(rows, 0.1, 1.0, 3) and [r[:4] for r in got] == [("a", "gradual", 1, 600)]


def test_defined_cases(spark):
    assert _got(spark, [], 0.1, 1.0) == []
    rows = [("one", 0, [1.0, 0.0]), ("none", 0, None), ("hole", 0, [1.0, 0.0]), ("hole", 7, None), ("hole", 9, [1.0, 0.0]),
            ("nan", 0, [1.0, 0.0]), ("nan", 1, [float("nan"), 0.0])]
    want = [("hole", "cut", 7, 7, 2 * UNIT), ("hole", "cut", 9, 9, 2 * UNIT), ("nan", "cut", 1, 1, 2 * UNIT)]
    assert _got(spark, rows, 0.1, 1.0, rest=0) == want
    assert _got(spark, rows, 0.1, 1.0, rest=1) == [want[0], want[2]]
    with pytest.raises(ValueError):
        shot_transitions(spark.createDataFrame([], SCHEMA), 0.5, 0.1)
    assert IDLE == (0, None, None, 0)
