"""Listings inside the round or drawn zones of many searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.geo import METRES_PER_DEGREE, cell, haversine_m, in_polygon
from hearthmark.operators.skew import grid_join


def _columns_round(cell_deg: float) -> int:
    return round(360 / cell_deg)


def _cells(df: DataFrame, south: Column, north: Column, west: Column, east: Column, cell_deg: float) -> DataFrame:
    """One row per grid cell touched by a bounding box; columns wrap at the date line."""
    columns = _columns_round(cell_deg)
    rows = F.sequence(cell(south, cell_deg), cell(north, cell_deg))
    first = cell(west, cell_deg)
    last = F.least(cell(east, cell_deg), first + columns - 1)
    return df.withColumn("_row", F.explode(rows)).withColumn("_raw", F.explode(F.sequence(first, last))).withColumn(
        "_column", F.pmod(F.col("_raw"), F.lit(columns))
    ).drop("_raw")


def _point_cells(points: DataFrame, cell_deg: float) -> DataFrame:
    located = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return located.withColumns(
        {
            "_row": cell(F.col("lat"), cell_deg),
            "_column": F.pmod(cell(F.col("lng"), cell_deg), F.lit(_columns_round(cell_deg))),
        }
    )


def radius_join(
    points: DataFrame, zones: DataFrame, cell_deg: float = 0.1, point_id: str = "id", zone_id: str = "search_id", piece_rows: int = 20_000
) -> DataFrame:
    """Pairs of a point and a round zone at most ``radius_km`` apart.

    A zone is spread over the grid cells of its bounding box, a point has one
    cell; the cell equality is the join key and the exact distance the filter.
    A cell that many points or zones share is split by their ids.
    """
    reach = F.col("radius_km") * 1000.0 / METRES_PER_DEGREE * F.lit(1.000001)
    widest = F.cos(F.radians(F.least(F.lit(89.9), F.abs("center_lat") + reach)))
    wide = F.least(F.lit(180.0), reach / widest)
    spread = _cells(
        zones.where(F.col("center_lat").isNotNull() & F.col("center_lng").isNotNull() & F.col("radius_km").isNotNull()),
        F.col("center_lat") - reach,
        F.col("center_lat") + reach,
        F.col("center_lng") - wide,
        F.col("center_lng") + wide,
        cell_deg,
    )
    distance = haversine_m(F.col("center_lat"), F.col("center_lng"), F.col("lat"), F.col("lng"))
    return (
        grid_join(_point_cells(points, cell_deg), spread, ["_row", "_column"], point_id, zone_id, piece_rows)
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= F.col("radius_km") * 1000.0)
        .drop("_row", "_column")
    )


def polygon_join(
    points: DataFrame, zones: DataFrame, cell_deg: float = 0.1, point_id: str = "id", zone_id: str = "search_id", piece_rows: int = 20_000
) -> DataFrame:
    """Pairs of a point and a drawn zone (three vertices or more) that contains it."""
    drawn = zones.where(F.size("polygon") >= 3)

    def bound(pick, field: str) -> Column:
        return pick(F.transform("polygon", lambda v: v[field]))

    spread = _cells(
        drawn,
        bound(F.array_min, "lat"),
        bound(F.array_max, "lat"),
        bound(F.array_min, "lng"),
        bound(F.array_max, "lng"),
        cell_deg,
    )
    return (
        grid_join(_point_cells(points, cell_deg), spread, ["_row", "_column"], point_id, zone_id, piece_rows)
        .where(in_polygon(F.col("lng"), F.col("lat"), F.col("polygon")))
        .drop("_row", "_column")
    )


def map_layers(listings: DataFrame, searches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings with coordinates, active round zones, active drawn zones."""
    located = listings.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    active = searches.where("active")
    circles = active.where(F.col("center_lat").isNotNull() & F.col("center_lng").isNotNull() & (F.col("radius_km") != 0))
    polygons = active.where(F.size("polygon") >= 3)
    return located, circles, polygons
