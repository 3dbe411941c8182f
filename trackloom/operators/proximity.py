"""Points near places, by an equi-join on grid cells.

A place is put into every cell that its circle's bounding box touches, a point into its own cell, so the
join's candidates are only points in cells near a place, whatever the size of either side.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.shared import forget, written

#: No two places on the globe are farther apart.
HALF_ROUND_M = math.pi * geo.EARTH_RADIUS_M


def near(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """points joined with every place at most radius_m away, with distance_m.

    points have lat and lon; places have place_lat and place_lon and no other column of points. Cells are
    one radius high; longitudes are cut so that a cell is at least as wide at the places' highest latitude. A place whose
    circle crosses the date line also stands on its other side.
    """
    height = radius_m / 111_000.0
    top = places.agg(F.max(F.abs("place_lat"))).first()[0] or 0.0
    shrink = max(0.05, math.cos(math.radians(min(89.0, top + height))))
    width = height / shrink
    cell = lambda v, size: F.floor(v / size)
    turned = places.withColumn("turn_lon", F.explode(F.array(*(F.col("place_lon") + t for t in (-360.0, 0.0, 360.0)))))
    turned = turned.where((F.col("turn_lon") == F.col("place_lon")) | (F.abs("turn_lon") <= 180.0 + width))
    spread = turned.withColumns(
        {
            "cell_y": F.explode(F.sequence(cell(F.col("place_lat") - height, height), cell(F.col("place_lat") + height, height))),
        }
    ).withColumn("cell_x", F.explode(F.sequence(cell(F.col("turn_lon") - width, width), cell(F.col("turn_lon") + width, width))))
    placed = points.withColumns({"cell_y": cell(F.col("lat"), height), "cell_x": cell(F.col("lon"), width)})
    distance = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    # Of a place's copies a point meets the one on its own side.
    apart = F.col("lon") - F.col("turn_lon")
    met = placed.join(spread, ["cell_y", "cell_x"]).where((apart > -180.0) & (apart <= 180.0))
    return met.withColumn("distance_m", F.round(distance, 3)).where(F.col("distance_m") <= radius_m).drop("cell_y", "cell_x", "turn_lon")


def nearest(points: DataFrame, key: list[str], places: DataFrame, radius_m: float) -> DataFrame:
    """key, identifier and distance_m of the place nearest to each point, if one is within radius_m; equal distances go to the lower place_ord.

    Of places at one position only the lowest place_ord can win. Distance (in millimetres, as near() rounds it) and place_ord
    are one number, whose minimum is hashed while pairs are made: pairs are neither sorted nor shuffled.
    """
    own = places.groupBy("place_lat", "place_lon").agg(F.min(F.struct("place_ord", "identifier")).alias("own")).select("place_lat", "place_lon", F.col("own.place_ord").cast("long").alias("place_ord"), "own.identifier")
    millis = F.round(F.col("distance_m") * 1000).cast("decimal(11,0)")
    both = millis * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + (F.col("place_ord").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)"))
    pairs = near(points.select(*key, "lat", "lon"), own.drop("identifier"), radius_m)
    best = pairs.groupBy(*key, "lat", "lon").agg(F.min(both.cast("decimal(38,0)")).alias("both"))
    best = best.withColumn("millis", F.floor(F.col("both") / F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).cast("decimal(11,0)"))
    best = best.withColumn("place_ord", (F.col("both") - F.col("millis") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") - F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).cast("long"))
    met = best.join(own, "place_ord").withColumn("distance_m", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")), 3))
    # A place_ord may stand at several positions.
    met = met.where(F.round(F.col("distance_m") * 1000).cast("decimal(11,0)") == F.col("millis"))
    return met.groupBy(*key).agg(F.min("identifier").alias("identifier"), F.min("distance_m").alias("distance_m"))


def fix_sequences(rows: DataFrame, fixes: DataFrame, radius_m: float = 2000.0) -> DataFrame:
    """Per segment the fixes it passed in order, joined by >; a point away from all fixes lets the same fix count again.

    rows: segment rows with rn; fixes: identifier, place_lat, place_lon, place_ord. Segments without
    valid positions do not appear.
    """
    key = ["source_flight", "segment"]
    hits = nearest(rows.select(*key, "rn", "lat", "lon"), [*key, "rn"], fixes, radius_m).select(*key, "rn", "identifier")
    order = Window.partitionBy(*key).orderBy("rn")
    joined = rows.join(hits, [*key, "rn"], "left").withColumn("last", F.lag("identifier").over(order))
    new = F.col("identifier").isNotNull() & ~F.col("identifier").eqNullSafe(F.col("last"))
    taken = F.array_sort(F.collect_list(F.when(new, F.struct("rn", "identifier"))))
    by = joined.groupBy(*key).agg(F.first("flight_id").alias("flight_id"), F.first("callsign").alias("callsign"), F.first("icao24").alias("icao24"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), taken.alias("taken"))
    sequence = F.array_join(F.transform("taken", lambda t: t["identifier"]), ">")
    return by.select("flight_id", "callsign", "icao24", "first_time", "last_time", sequence.alias("fix_sequence"), F.size("taken").alias("fix_count"))


def nearest_threshold(points: DataFrame, thresholds: DataFrame, radius_m: float = 4_000.0, growth: float = 4.0) -> DataFrame:
    """Per flight the runway that any of its points comes closest to, and that distance; equal ones go to the lower place_ord.

    A search in rings: what lies within the radius is met by grid cells, and only flights that found nothing there look
    again, in a wider one, until the ring spans the globe. A point that lies in no ring adds nothing to a flight that found
    one. Each round keeps one best a flight before it shuffles. Flights without a position have no row.
    """
    runways = thresholds.select("place_ord", "runway", "place_lat", "place_lon")
    left = written(points.select("flight_id", "lat", "lon").where("flight_id is not null and lat is not null and lon is not null"), "points")
    best = F.min(F.struct("distance_m", "place_ord", "runway")).alias("best")
    found, radius = None, radius_m
    while True:
        here = written(near(left, runways, radius).groupBy("flight_id").agg(best).select("flight_id", "best.runway", "best.distance_m"), "nearest")
        found = here if found is None else found.unionByName(here)
        before, left = left, written(left.join(here.select("flight_id"), "flight_id", "left_anti"), "points")
        forget(before)
        if radius > HALF_ROUND_M or left.isEmpty():
            forget(left)
            return found
        radius *= growth


