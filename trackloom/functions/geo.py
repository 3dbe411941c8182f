"""Column functions over positions on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius.
EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance with longitudes scaled at the middle latitude."""
    east = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_RADIUS_M * F.sqrt(east * east + F.pow(F.radians(lat2 - lat1), 2))


def local_east_m(lat0: Column, lon: Column, lon0: Column) -> Column:
    return EARTH_RADIUS_M * F.cos(F.radians(lat0)) * F.radians(lon - lon0)


def local_north_m(lat: Column, lat0: Column) -> Column:
    return EARTH_RADIUS_M * F.radians(lat - lat0)


def latitude_of(north_m: Column, lat0: Column) -> Column:
    return lat0 + F.degrees(north_m / EARTH_RADIUS_M)


def longitude_of(east_m: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + F.degrees(east_m / (EARTH_RADIUS_M * F.cos(F.radians(lat0))))


def wrap_rad(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def heading_to_math_rad(heading_deg: Column) -> Column:
    """Compass heading in degrees as an angle from east, counter-clockwise, wrapped."""
    return wrap_rad(F.radians(90.0 - heading_deg))


def extent(lat: Column, lon: Column, radius_m: Column) -> Column:
    """struct(west, east, south, north) of a box that holds a circle; fixed value: 111320 m a degree."""
    dlat = radius_m / 111_320.0
    dlon = radius_m / (111_320.0 * F.greatest(F.cos(F.radians(lat)), F.lit(0.2)))
    return F.struct((lon - dlon).alias("west"), (lon + dlon).alias("east"), (lat - dlat).alias("south"), (lat + dlat).alias("north"))


def along_track_wind(east: Column, north: Column, track_rad: Column) -> Column:
    return east * F.cos(track_rad) + north * F.sin(track_rad)
