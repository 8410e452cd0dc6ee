import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketreach.operators import quantiles
from marketreach.operators.quantiles import exact_percentiles, percentiles_by_key

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


def groups(rng):
    return {
        "hot": [10000.0] * 400 + [rng.lognormvariate(8, 3) for _ in range(700)],
        "few": [3.0, 1.0],
        "one": [7.5],
        "same": [2.0] * 50,
        "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(300)],
        "whole": [float(rng.randrange(5)) for _ in range(200)],
    }


@pytest.mark.parametrize("leaf", [3, 40, 1 << 16])
def test_against_numpy(spark, monkeypatch, leaf):
    """With a small leaf the hot key is narrowed several times, its ranks in different buckets."""
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    data = groups(random.Random(7))
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r.k, r.prob): r.valor for r in exact_percentiles(df, ["k"], "v", PROBS, leaf).collect()}
    assert len(got) == len(data) * len(PROBS)
    for k, values in data.items():
        for p in PROBS:
            assert np.isclose(got[k, p], np.percentile(values, p * 100), rtol=1e-9, atol=0), (k, p)


def test_without_keys(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    row = percentiles_by_key(df, [], "v", {"p05": 0.05, "p95": 0.95}).first()
    assert (row.p05, row.p95) == (0.5, 9.5)
    assert [r.valor for r in exact_percentiles(df, [], "v", [0.5]).collect()] == [5.0]
    assert exact_percentiles(df.where("false"), [], "v", [0.5]).count() == 0


def test_many_values_of_one_key(spark):
    """Rounds leave few values to order, whatever a key holds."""
    n = 300_000
    df = spark.range(n).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    rounds = []
    narrowed = quantiles._narrowed

    def counted(*args):
        rounds.append(narrowed(*args))
        return rounds[-1]

    quantiles._narrowed = counted
    try:
        got = {r.prob: r.valor for r in exact_percentiles(df, ["k"], "v", [0.25, 0.5], 2000).collect()}
    finally:
        quantiles._narrowed = narrowed
    assert got == {0.25: (n - 1) * 0.25, 0.5: (n - 1) * 0.5}
    assert [r.count() < n / 16 for r in rounds] == [True] * len(rounds) and len(rounds) == 2
    assert rounds[-1].groupBy("_cell").count().agg(F.max("count")).first()[0] <= 2000
