"""Exact percentiles that never bring a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach.operators.joins import own_exchange
from marketreach.session import stage

BUCKETS = 128
LEAF = 1 << 16  # most distinct values that are put in order together


def _narrowed(values: DataFrame, cells: list[str], wanted: DataFrame, by: list[str]) -> DataFrame:
    """Written table of the buckets of `values` that hold a wanted rank; `_cell` and `_start` are theirs.

    A mergeable sketch cuts the distinct values of a cell into `BUCKETS` buckets. It decides how even
    they are, never the result.
    """
    grid = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = values.groupBy(*cells).agg(F.percentile_approx("_v", grid, BUCKETS * 10).alias("_cuts"))
    cut = values.join(own_exchange(cuts), cells).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))).cast("long")
    ).drop("_cuts")
    before = Window.partitionBy(*cells).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(*cells, "_start", "_b").agg(F.sum("_n").alias("_bn")).withColumn(
        "_from", F.col("_start") + F.coalesce(F.sum("_bn").over(before), F.lit(0))
    )
    holds = F.exists("_ranks", lambda r: r.between(F.col("_from"), F.col("_from") + F.col("_bn") - 1))
    kept = spans.join(wanted, by).where(holds).select(*cells, "_b", "_from")
    return stage(
        cut.join(own_exchange(kept), [*cells, "_b"]).select(
            *by, (F.col("_cell") * (BUCKETS + 1) + F.col("_b")).alias("_cell"), F.col("_from").alias("_start"), "_v", "_n"
        )
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], leaf: int = LEAF
) -> DataFrame:
    """`keys, prob, valor`: linearly interpolated percentiles per key.

    Equal values are counted first, and the counts staged. While a key's values, or the part of them
    that is left, are more than `leaf`, the buckets that hold a wanted rank are cut out and the rest
    is let go; only what then remains is ordered. The number of rounds grows with the logarithm of
    the distinct values of a key, and no task orders more than `leaf` of them at a time.
    """
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    values = stage(
        keyed.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    ).withColumns({"_cell": F.lit(0).cast("long"), "_start": F.lit(0).cast("long")})
    cells = [*by, "_cell"]

    def rank(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    ends = F.array_distinct(F.array(*[f(rank(p)) for p in probs for f in (F.floor, F.ceil)]))
    wanted = None
    while (values.groupBy(*cells).count().agg(F.max("count")).first()[0] or 0) > leaf:
        if wanted is None:
            totals = values.groupBy(*by).agg(F.sum("_n").alias("_total"))
            wanted = stage(totals.select(*by, "_total", ends.alias("_ranks")))
        values = _narrowed(values, cells, wanted, by)

    per_cell = Window.partitionBy(*cells)
    inside = per_cell.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    if wanted is None:  # a key is one cell, so its total is at hand
        placed = placed.withColumn("_total", F.sum("_n").over(per_cell))
    else:
        placed = placed.join(own_exchange(wanted.select(*by, "_total")), by)

    def at_rank(where: Column) -> Column:
        return F.max(F.when(where.between(F.col("_first"), F.col("_first") + F.col("_n") - 1), F.col("_v")))

    ends_of = [
        at_rank(end(rank(p))).alias(f"_{side}{i}")
        for i, p in enumerate(probs)
        for side, end in (("lo", F.floor), ("hi", F.ceil))
    ]
    found = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *ends_of)
    rows = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (rank(p) - F.floor(rank(p)))).alias("valor"),
        )
        for i, p in enumerate(probs)
    ]
    return found.select(*keys, F.inline(F.array(*rows)))


def percentiles_by_key(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per key with a column per named percentile."""
    long = exact_percentiles(df, keys, value, list(probs.values()))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("valor"))).alias(n) for n, p in probs.items()]
    )
