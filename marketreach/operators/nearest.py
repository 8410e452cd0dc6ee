"""Exact nearest site on the sphere, without comparing every point with every site.

Sites are indexed by a grid of cells that nest eight by eight, from 45 degrees down. Every cell
keeps the bounding box of its sites and one site as witness, and the same for its chosen sites. A
point starts with the occupied cells of the deepest grid that has few of them and descends: the
distance to a box is a lower bound, the distance to the witness an upper bound, and cells that can
hold neither the nearest site nor the nearest chosen one are dropped before the next join. One descent
answers both. Depth is chosen from the counted occupancy, so the last step sees few sites per cell.
All joins are equi-joins on cell ids; grids with a fixed small number of cells are broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach.functions.numeric import EARTH_RADIUS_KM, haversine_km
from marketreach.session import stage

COARSE_DEGREES = 45.0
ROWS, COLS = 4, 8  # coarsest grid
MAX_LEVEL = 6  # 45 / 8**6 degrees, about 19 m
BROADCAST_LEVEL = 2  # at most 256 x 512 = 131,072 cells
LEAF_SITES = 64
START_CELLS = 64  # most cells that a point starts with; the coarsest grid has 32
_SLACK_KM = 1e-6


def _index(degrees: Column, offset: float, count: int) -> Column:
    step = COARSE_DEGREES / 8**MAX_LEVEL
    cells = count * 8**MAX_LEVEL
    raw = F.floor((degrees + offset) / F.lit(step))
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), raw)).cast("long")


def _at_level(deep: Column, level: int) -> Column:
    return F.shiftright(deep, 3 * (MAX_LEVEL - level))


def _located(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def _wrap(degrees: Column) -> Column:
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def collapse_sites(sites: DataFrame, site_id: str, lat: str, lon: str, chosen: str | None = None) -> DataFrame:
    """One row per coordinate pair, with the smallest id there (`s_id`) and the smallest chosen one (`s_id1`)."""
    ids = [F.min(site_id).alias("s_id")]
    if chosen:
        ids.append(F.min(F.when(F.col(chosen), F.col(site_id))).alias("s_id1"))
    return _located(sites, lat, lon).groupBy(F.col(lat).alias("s_lat"), F.col(lon).alias("s_lon")).agg(*ids)


def _labels(sites: DataFrame) -> list[str]:
    """Suffixes of what is searched for: all sites, and the chosen ones if they are marked."""
    return ["", "1"] if "s_id1" in sites.columns else [""]


def _cells(sites: DataFrame, level: int) -> DataFrame:
    """Cells of a level: per label the box of its sites and a witness, null where it has none."""
    i, j = _at_level(F.col("s_i"), level), _at_level(F.col("s_j"), level)
    parts = []
    for x in _labels(sites):
        held = F.col(f"s_id{x}").isNotNull()
        lat, lon = F.when(held, F.col("s_lat")), F.when(held, F.col("s_x"))
        parts += [
            F.min(lat).alias(f"b_lat0{x}"),
            F.max(lat).alias(f"b_lat1{x}"),
            F.min(lon).alias(f"b_lon0{x}"),
            F.max(lon).alias(f"b_lon1{x}"),
            F.min_by("s_lon", lat).alias(f"w_lon{x}"),  # with b_lat0 a real site: one with the smallest latitude
        ]
    boxes = sites.groupBy(i.alias("ci"), j.alias("cj")).agg(*parts)
    if level:
        boxes = boxes.withColumns({"pi": F.shiftright("ci", 3), "pj": F.shiftright("cj", 3)})
    return F.broadcast(boxes) if level <= BROADCAST_LEVEL else boxes


def _lower_km(x: str) -> Column:
    """Lower bound of the distance from (p_lat, p_x) to any site in the box of a label; null without one."""
    lat0, lat1, lon0, lon1 = (F.col(f"b_{c}{x}") for c in ("lat0", "lat1", "lon0", "lon1"))
    up = F.greatest(F.lit(0.0), lat0 - F.col("p_lat"), F.col("p_lat") - lat1)
    aside = F.when(F.col("p_x").between(lon0, lon1), 0.0).otherwise(
        F.least(
            F.pmod(lon0 - F.col("p_x"), F.lit(360.0)),
            F.pmod(F.col("p_x") - lon1, F.lit(360.0)),
            F.lit(90.0),
        )
    )
    to_meridian = F.asin(
        F.least(F.lit(1.0), F.cos(F.radians("p_lat")) * F.sin(F.radians(aside)))
    )
    return F.when(lat0.isNotNull(), EARTH_RADIUS_KM * F.greatest(F.radians(up), to_meridian) - _SLACK_KM)


def _prune(frontier: DataFrame, labels: list[str]) -> DataFrame:
    """Bounds per candidate cell, then drop the cells that can win for no label."""
    point = Window.partitionBy("p_lat", "p_lon")

    def open_(best) -> Column:
        return reduce(or_, [F.coalesce(F.col(f"lower{x}") <= best(x), F.lit(False)) for x in labels])

    bounds = {f"lower{x}": _lower_km(x) for x in labels} | {
        f"upper{x}": haversine_km(F.col("p_lat"), F.col("p_lon"), F.col(f"b_lat0{x}"), F.col(f"w_lon{x}")) for x in labels
    }
    bounded = frontier.withColumns(bounds).where(open_(lambda x: F.col(f"best{x}")))
    best = {f"best{x}": F.least(F.col(f"best{x}"), F.min(f"upper{x}").over(point)) for x in labels}
    kept = bounded.withColumns(best).where(open_(lambda x: F.col(f"best{x}")))
    return kept.select("p_lat", "p_lon", "p_x", *best, "ci", "cj")


def _levels(sites: DataFrame, leaf: int) -> tuple[int, int]:
    """The level to start at and the last one.

    The last is the first whose fullest cell holds at most `leaf` sites; the start is the deepest up
    to it that has at most `START_CELLS` occupied cells.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL)))
    keyed = sites.select("s_i", "s_j", levels.alias("level"))
    shift = F.expr(f"3 * ({MAX_LEVEL} - level)")
    filled = (
        keyed.groupBy(
            "level",
            F.call_function("shiftright", F.col("s_i"), shift).alias("i"),
            F.call_function("shiftright", F.col("s_j"), shift).alias("j"),
        )
        .count()
        .groupBy("level")
        .agg(F.max("count").alias("fullest"), F.count("*").alias("cells"))
    ).collect()  # one row per level, none without sites
    last = min((r["level"] for r in filled if r["fullest"] <= leaf), default=MAX_LEVEL if filled else 0)
    few = [r["level"] for r in filled if r["cells"] <= START_CELLS and r["level"] <= min(last, BROADCAST_LEVEL)]
    return max(few, default=0), last


def nearest_site(
    points: DataFrame,
    sites: DataFrame,
    site_id: str,
    lat: str = "lat",
    lon: str = "lon",
    leaf: int = LEAF_SITES,
    chosen: str | None = None,
) -> DataFrame:
    """`lat, lon, site_id, dist_km` for every distinct located point; ties go to the smallest id.

    With `chosen`, a boolean column of the sites, also `{site_id}_chosen, dist_km_chosen`: the nearest of
    the sites where it holds, null without any. Empty when there are no located sites.
    """
    indexed = collapse_sites(sites, site_id, lat, lon, chosen).withColumns(
        {"s_x": _wrap(F.col("s_lon"))}
    )
    indexed = indexed.withColumns(
        {
            "s_i": _index(F.col("s_lat"), 90.0, ROWS),
            "s_j": _index(F.col("s_x"), 180.0, COLS),
        }
    )
    indexed = stage(indexed)
    labels = _labels(indexed)
    start, depth = _levels(indexed, leaf)

    found = _located(points, lat, lon).select(
        F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"), _wrap(F.col(lon)).alias("p_x")
    ).distinct()
    # at most START_CELLS cells, by number
    first = _cells(indexed, start).drop("pi", "pj").withColumn("_c", F.row_number().over(Window.orderBy("ci", "cj")))
    starts = F.explode(F.sequence(F.lit(1), F.lit(START_CELLS)))
    frontier = found.select("*", *[F.lit(float("inf")).alias(f"best{x}") for x in labels], starts.alias("_c"))
    frontier = _prune(frontier.join(F.broadcast(first), "_c"), labels)

    def descend(open_cells: DataFrame, level: int) -> DataFrame:
        parents = open_cells.withColumnsRenamed({"ci": "pi", "cj": "pj"})
        return _prune(parents.join(_cells(indexed, level), ["pi", "pj"]), labels)

    frontier = reduce(descend, range(start + 1, depth + 1), frontier)

    last = indexed.select(
        _at_level(F.col("s_i"), depth).alias("ci"),
        _at_level(F.col("s_j"), depth).alias("cj"),
        "s_lat", "s_lon", *[f"s_id{x}" for x in labels],
    )
    pairs = frontier.join(last, ["ci", "cj"]).withColumn(
        "km", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("s_lat"), F.col("s_lon"))
    )
    hits = [
        F.min(F.when(F.col(f"s_id{x}").isNotNull(), F.struct("km", F.col(f"s_id{x}").alias("id")))).alias(f"hit{x}")
        for x in labels
    ]
    out = [
        F.col(f"hit{x}.{c}").alias(name + ("_chosen" if x else ""))
        for x in labels
        for c, name in (("id", site_id), ("km", "dist_km"))
    ]
    return pairs.groupBy("p_lat", "p_lon").agg(*hits).select(
        F.col("p_lat").alias(lat), F.col("p_lon").alias(lon), *out
    )
