"""Join helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach.functions.text import clean_id, place_key

FILTER_WORDS = 1 << 16  # 64-bit words of a key filter: 512 KB


def own_exchange(side: DataFrame) -> DataFrame:
    """Join side that brings no partitioning of its own.

    A side aggregated by the join key lends its partitioning to the join, and then the other
    side's hot key cannot be split at run time. One more exchange of one row per key avoids that.
    """
    return side.hint("rebalance")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the first in `order` (end it with a unique column)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias(
            "_row"
        )
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def describe(
    df: DataFrame, lookup: DataFrame, on: str, code: str, desc: str, alias: str
) -> DataFrame:
    """LEFT join of one description column from a code table."""
    side = lookup.select(F.col(code).alias(on), F.col(desc).alias(alias))
    return df.join(side, on, "left")


def only_matching(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is in `ids` (semi join)."""
    return df.join(own_exchange(ids.select(on).distinct()), on, "left_semi")


def without_matching(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is not in `ids` (anti join)."""
    return df.join(ids.select(on), on, "left_anti")


def _bit_places(value: Column) -> tuple[Column, Column]:
    """Two places of a value among the bits of a filter, from the halves of one hash."""
    h, mask = F.xxhash64(value), F.lit(64 * FILTER_WORDS - 1).cast("long")
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)


def key_filter(ids: DataFrame, on: str) -> Callable[[Column], Column]:
    """Condition that holds for every value of `ids` and, the fewer they are, for few others.

    The values set bits of a table of fixed size, which the plan works out once and sends along as a
    scalar. It is put on the long side of a join before that side moves; the join itself stays exact.
    Unlike a semi join it neither moves the long side nor lends it a partitioning, so a hot id can
    still be split. More than some millions of values fill the table, and then all rows pass.
    """
    places = F.explode(F.array(*_bit_places(F.col(on))))
    bits = ids.where(F.col(on).isNotNull()).select(places.alias("_p")).groupBy(
        F.shiftright("_p", 6).alias("id")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_w"))
    table = ids.sparkSession.range(FILTER_WORDS).join(bits, "id", "left").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("id", F.coalesce("_w", F.lit(0).cast("long")).alias("w")))), lambda r: r["w"]
        )
    ).scalar()

    def holds(value: Column) -> Column:
        tests = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) for p in _bit_places(value)]
        return (tests[0] == 1) & (tests[1] == 1)

    return holds


def attach_place(
    df: DataFrame,
    centroids: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    code: str = "CD_MUN",
    name: str = "municipio_nome",
    uf: str = "uf",
) -> DataFrame:
    """Municipality centroid and code by accent-free `NAME|UF`; an unknown place gives NULLs."""
    side = centroids.select(
        place_key(F.col("NM_MUN"), F.col("SIGLA_UF")).alias("_place"),
        F.col("CD_MUN").alias(code),
        F.col("lat").alias(lat),
        F.col("lon").alias(lon),
    ).where(F.col("_place").isNotNull())
    side = keep_one(side, ["_place"], [F.col(code), F.col(lat), F.col(lon)])
    base = df.drop(lat, lon, code)
    keyed = base.withColumn("_place", place_key(F.col(name), F.col(uf)))
    return keyed.join(own_exchange(side), "_place", "left").drop("_place")


def with_id(df: DataFrame, key: str, alias: str = "_id") -> DataFrame:
    """Adds the normalised 14-digit id."""
    return df.withColumn(alias, clean_id(F.col(f"`{key}`")))
