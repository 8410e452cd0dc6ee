"""Exact top-k against brute force, on defined cases and random vectors."""

import math
from decimal import Decimal

import numpy as np
import pytest

from marketreach.llm import topk

SCHEMA = "vec_id long, embedding array<double>, part long, ids string"


def _brute(rows, k=10, every=100):
    """Lists of every query, ids with null last."""
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(1024 * x) for x in v):
            return None
        return [int(Decimal(1024 * x).to_integral_value("ROUND_FLOOR")) for x in v]

    low, high = -(2**63), 2**63 - 1
    fine = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    out = []
    for a, (q, x) in enumerate(fine):
        if q is None or q % every:
            continue
        found = [(min(max(sum(p * r for p, r in zip(x, y)), low), high), c) for b, (c, y) in enumerate(fine) if a != b]
        found.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, rank + 1, c, s) for rank, (s, c) in enumerate(found[:k])]
    return sorted(out, key=str)


def _frame(spark, rows):
    fixed = lambda v: v and [x if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, fixed(v), 1, "x") for i, v in rows], SCHEMA)


def _got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_defined_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf"), 1.0]),
        (5, []), (100, [0.5, -0.25, 3.0, 1, 1, 1, 1, 1, 1, 9.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-1e-9, 1e-9]),
        (-100, [1e30, 1.0]), (9, [-1e30] * 12), (10, [1e300, 1e300]), (11, [1e306]), (200, [0.1] * 5000),
    ]
    assert _got(topk.top(_frame(spark, rows))) == _brute(rows)
    assert _got(topk.top(_frame(spark, rows), k=2, every=1)) == _brute(rows, 2, 1)


def test_empty_table(spark):
    assert _got(topk.top(_frame(spark, [(1, [1.0])]).limit(0))) == []
    assert _got(topk.top(_frame(spark, [(0, [1.0])]))) == []


@pytest.mark.parametrize("held", [1, 16])
def test_random_vectors(spark, monkeypatch, held):
    monkeypatch.setattr(topk, "ROWS", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 20))
    vectors = np.concatenate((near[rng.integers(0, 6, 300)] + 0.01 * rng.normal(size=(300, 20)), rng.normal(size=(300, 20))))
    rows = [(int(i), [round(float(x), 2) for x in v]) for i, v in zip(rng.permutation(600), vectors)]
    got = topk.top(_frame(spark, rows).repartition(5), every=60, held=held)
    assert _got(got) == _brute(rows, every=60)


def test_candidates_are_dropped_before_the_last_run():
    """A list that is full of close vectors leaves few candidates for the later runs."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64) * 100
    rows = [(i, base + rng.normal(size=64)) for i in range(12)] + [(100 + i, rng.normal(size=64) * 100) for i in range(2000)]

    def block(part):
        runs, lengths = topk.packed([(i, np.floor(v)) for i, v in part])
        ids = topk.pa.array([i for i, _ in part], topk.pa.int64())
        return topk.Block(topk.pa.array(runs, topk.pa.binary()), lengths, ids)

    q, near, far = block(rows[:1]), block(rows[1:12]), block(rows[12:])
    best = [topk.Best(10)]
    topk.meet(q, np.array([-1]), near, 0, best)
    full = best[0].least
    bounds = (q.lengths.T @ far.lengths)[0]
    assert full is not None and (bounds < full).mean() < 1  # lengths alone do not decide
    topk.meet(q, np.array([-1]), far, 0, best)
    assert set(best[0].ids.tolist()) <= set(range(1, 12))
