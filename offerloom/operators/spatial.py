"""Nearest places of a group by descent through a hierarchy of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import EARTH_RADIUS_M
from ..session import cut_lineage

#: Cell sizes in degrees, a quarter of the one before; the last is about 15 m.
LEVELS = tuple(32.0 / 4 ** i for i in range(10))
#: Groups of at most this many distinct positions are compared directly.
SMALL = 256


def _arc(dlat: Column, dlon: Column, cosines: Column) -> Column:
    """Square of the sine of half the angle between two positions, which grows with their distance."""
    return F.pow(F.sin(F.radians(dlat) / 2), 2) + cosines * F.pow(F.sin(F.radians(dlon) / 2), 2)


def _bounds() -> tuple[Column, Column]:
    """Least and greatest arc between a point (plat, plon) and any position in a box."""
    plat, plon, south, north, west, east = (F.col(x) for x in ("plat", "plon", "south", "north", "west", "east"))
    a, b = F.cos(F.radians(south)), F.cos(F.radians(north))
    widest = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(a, b))
    to_west, to_east = F.pmod(west - plon, F.lit(360.0)), F.pmod(plon - east, F.lit(360.0))  # eastwards to the box, and on from it
    inside = (plon >= west) & (plon <= east)
    near_lon = F.when(inside, F.lit(0.0)).otherwise(F.least(to_west, to_east, F.lit(180.0)))
    far_lon = F.least(F.lit(180.0), F.greatest(F.abs(plon - west), F.abs(plon - east)))
    far_lon = F.when(F.greatest(F.abs(plon - west), F.abs(plon - east)) > 180, F.lit(180.0)).otherwise(far_lon)
    near_lat = F.when(plat < south, south - plat).when(plat > north, plat - north).otherwise(0.0)
    far_lat = F.greatest(F.abs(plat - south), F.abs(plat - north))
    here = F.cos(F.radians(plat))
    return _arc(near_lat, near_lon, here * F.least(a, b)), _arc(far_lat, far_lon, here * widest)


def _kept(rows: DataFrame, k: int, slack: float) -> DataFrame:
    """Rows that may hold one of the k nearest: those not beyond the arc within which k positions surely lie."""
    by_far = W.partitionBy("point_id", "group").orderBy("far").rowsBetween(W.unboundedPreceding, W.currentRow)
    enough = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(W.partitionBy("point_id", "group"))
    limit = F.pow(F.sqrt(F.col("limit")) + slack, 2) + 1e-15
    return rows.withColumn("upto", F.sum("n").over(by_far)).withColumn("limit", enough).where(
        F.col("limit").isNull() | (F.col("near") <= limit)).drop("upto", "limit")


def candidates(points: DataFrame, nodes: DataFrame, k: int, slack: float) -> DataFrame:
    """``point_id, group, plat, plon`` with the ``lat, lon, n`` of the nodes that may be among the k nearest."""
    spots = points.select("point_id", "group", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    leaf = len(LEVELS) - 1
    placed = nodes.select("*", F.floor((F.col("lat") + 90) / LEVELS[leaf]).alias("row"), F.floor((F.col("lon") + 180) / LEVELS[leaf]).alias("col"))
    near, far = _bounds()
    cells = [placed.groupBy("group", "row", "col").agg(
        F.sum("n").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))]
    for _ in range(leaf):  # from the leaves up
        up = cells[-1].withColumns({"row": F.floor(F.col("row") / 4), "col": F.floor(F.col("col") / 4)})
        cells.append(up.groupBy("group", "row", "col").agg(
            F.sum("n").alias("n"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east")))
    frontier, on = spots.join(cells[-1], "group"), ["group", "up_row", "up_col"]
    for below in reversed(cells[:-1]):
        frontier = _kept(frontier.withColumns({"near": near, "far": far}), k, slack).select("point_id", "group", "plat", "plon", F.col("row").alias("up_row"), F.col("col").alias("up_col"))
        frontier = frontier.join(below.withColumns({"up_row": F.floor(F.col("row") / 4), "up_col": F.floor(F.col("col") / 4)}), on).drop("up_row", "up_col")
    leaves = _kept(frontier.withColumns({"near": near, "far": far}), k, slack).select("point_id", "group", "plat", "plon", "row", "col")
    return leaves.join(placed, ["group", "row", "col"]).select("point_id", "group", "plat", "plon", "lat", "lon", "n")


def nearest(points: DataFrame, places: DataFrame, k: int = 1, slack_m: float = 0.0, small: int = SMALL) -> DataFrame:
    """``point_id, group, place_id``: for each point the places of its group that are no farther than the k-th nearest.

    ``points``: point_id, group, lat, lon; ``places``: place_id, group, lat, lon and, where some places do not count
    towards the k, ``weight`` (1 or 0; then the k-th nearest is one that counts). Ties with the k-th one, and
    places up to ``slack_m`` beyond it, are included. Places at one position count as one node. A
    point meets all nodes of a small group. In a larger one it descends from coarse cells to fine ones and
    follows a cell only if it may be nearer than cells that surely hold k places, so the rows of a
    point do not grow with the group. Points and places without coordinates are left out.
    """
    at = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    there = places.where("lat IS NOT NULL AND lon IS NOT NULL")
    counted = F.sum("weight") if "weight" in places.columns else F.count(F.lit(1))
    nodes = cut_lineage(there.groupBy("group", "lat", "lon").agg(counted.alias("n")))
    large = cut_lineage(nodes.groupBy("group").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > small).select("group"))
    slack = slack_m / (2 * EARTH_RADIUS_M)  # of the square root of the arc, whose slope is one at most
    some = bool(large.take(1))
    few = nodes.join(large, "group", "left_anti") if some else nodes
    spots = at.select("point_id", "group", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    met = spots.join(few, "group").select("point_id", "group", "plat", "plon", "lat", "lon", "n")
    if some:
        met = met.unionByName(candidates(at.join(large, "group", "left_semi"), nodes.join(large, "group", "left_semi"), k, slack))
    cosines = F.cos(F.radians("plat")) * F.cos(F.radians("lat"))
    exact = _arc(F.col("lat") - F.col("plat"), F.col("lon") - F.col("plon"), cosines)
    kept = _kept(met.withColumn("near", exact).withColumn("far", F.col("near")), k, slack)
    return kept.select("point_id", "group", "lat", "lon").join(there.select("place_id", "group", "lat", "lon"), ["group", "lat", "lon"]).select("point_id", "group", "place_id")
