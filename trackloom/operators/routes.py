"""Routes of named fixes as sampled reference paths, and quantities along them.

A path is a table of samples (route_id, idx, s, east_m, north_m, lat, lon, track_rad, curvature), s being
the distance to its end. Splines are solved in Arrow batches of whole routes, those of equally many waypoints
together; a route has a handful of waypoints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import flight, geo, interp, scalars
from trackloom.shared import dealt

#: Samples that a task makes at once, and numbers of the systems that it solves at once.
SAMPLES, MATRIX = 1 << 18, 1 << 22
SAMPLES_OF = "route_id long, idx int, s double, east_m double, north_m double, lat double, lon double, track_rad double, curvature double"


def resolve(routes: DataFrame, fixes: DataFrame) -> DataFrame:
    """(route_id, path) into waypoints (route_id, place, identifier, lat, lon); place from 1.

    Tokens are fixes of a table (identifier, lat, lon; one row each), or literal coordinates. An unknown
    fix, or a route of fewer than two waypoints, is an error.
    """
    tokens = routes.select("route_id", F.posexplode(scalars.path_tokens(F.col("path"))).alias("p", "token"))
    tokens = tokens.select("route_id", (F.col("p") + 1).alias("place"), "token", scalars.coordinate_token(F.col("token"), F.col("p") + 1).alias("literal"), F.upper("token").alias("identifier"))
    known = fixes.select("identifier", F.struct("identifier", "lat", "lon").alias("fix"))
    found = tokens.join(known, "identifier", "left").withColumn("w", F.coalesce("literal", "fix"))
    missing = F.raise_error(F.concat(F.lit("unknown fix: "), F.col("token")))
    few = F.raise_error(F.concat(F.lit("fewer than two waypoints on route "), F.col("route_id").cast("string")))
    counted = found.withColumn("size", F.count("*").over(Window.partitionBy("route_id")))
    checked = F.when(F.col("w").isNull(), missing.cast("double")).when(F.col("size") < 2, few.cast("double")).otherwise(F.col("w.lat"))
    return counted.select("route_id", "place", "w.identifier", checked.alias("lat"), "w.lon")


def cubic_through(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (rows: segments; columns: powers from 0) of the spline of degree at most three through all points.

    Two points give a line, three one parabola, more a cubic spline whose third derivative is continuous at the
    second and the last but one point.
    """
    n = len(u) - 1
    if n < 3:
        return np.tile(np.pad(np.polyfit(u, y, n)[::-1], (0, 3 - n)), (1, 1))
    a, b, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    powers = lambda x, d: [0.0] * d + [np.prod(range(k - d + 1, k + 1)) * x ** (k - d) for k in range(d, 4)]
    scale = u[-1]
    v = u / scale
    for i in range(n):
        for x, value in ((v[i], y[i]), (v[i + 1], y[i + 1])):
            a[row, 4 * i : 4 * i + 4], b[row] = powers(x, 0), value
            row += 1
    for i in range(1, n):
        for d in (1, 2, 3) if i in (1, n - 1) else (1, 2):
            a[row, 4 * i - 4 : 4 * i], a[row, 4 * i : 4 * i + 4] = powers(v[i], d), [-p for p in powers(v[i], d)]
            row += 1
    return np.linalg.lstsq(a, b, rcond=None)[0].reshape(n, 4) / scale ** np.arange(4)


def spline_value(u: np.ndarray, coefficients: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    segment = np.clip(np.searchsorted(u, at, side="right") - 1, 0, len(coefficients) - 1)
    c = coefficients[segment]
    return sum(c[:, k] * np.prod(range(k - order + 1, k + 1)) * at ** (k - order) for k in range(order, 4))


def cubics_through(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """cubic_through of many curves of equally many points: u and y (curves, points) into (curves, segments, 4)."""
    size, n = len(u), u.shape[1] - 1
    out = np.zeros((size, 1, 4))
    out[:, 0, 0] = y[:, 0]
    if n == 0:
        return out
    if n < 3:
        rise = np.diff(y, axis=1) / np.diff(u, axis=1)
        out[:, 0, 1] = rise[:, 0]
        if n == 2:
            out[:, 0, 2] = (rise[:, 1] - rise[:, 0]) / u[:, 2]
            out[:, 0, 1] -= out[:, 0, 2] * u[:, 1]
        return out
    scale = u[:, -1:]
    v = u / scale
    tight = np.diff(v, axis=1).min(1) < 1e-6  # such systems are left to least squares, one by one
    out = np.zeros((size, n, 4))
    for i in np.flatnonzero(tight).tolist():
        out[i] = cubic_through(u[i], y[i])
    good = np.flatnonzero(~tight)
    step = max(1, MATRIX // (4 * n) ** 2)
    for part in (good[k : k + step] for k in range(0, len(good), step)):
        a, b, row = np.zeros((len(part), 4 * n, 4 * n)), np.zeros((len(part), 4 * n)), 0
        powers = lambda x, d: np.stack([np.zeros(len(x))] * d + [np.prod(range(k - d + 1, k + 1)) * x ** (k - d) for k in range(d, 4)], axis=1)
        for i in range(n):
            for j in (i, i + 1):
                a[:, row, 4 * i : 4 * i + 4], b[:, row] = powers(v[part, j], 0), y[part, j]
                row += 1
        for i in range(1, n):
            for d in (1, 2, 3) if i in (1, n - 1) else (1, 2):
                p = powers(v[part, i], d)
                a[:, row, 4 * i - 4 : 4 * i], a[:, row, 4 * i : 4 * i + 4] = p, -p
                row += 1
        out[part] = np.linalg.solve(a, b[:, :, None])[:, :, 0].reshape(len(part), n, 4) / scale[part][:, :, None] ** np.arange(4)
    return out


def sampled_paths(lat: np.ndarray, lon: np.ndarray, per_segment: int) -> dict[str, np.ndarray]:
    """Samples of the smooth paths through many routes of equally many waypoints: each value as (routes, samples)."""
    shrink = np.cos(np.radians(lat[:, -1:]))
    east = geo.EARTH_RADIUS_M * shrink * np.radians(lon - lon[:, -1:])
    north = geo.EARTH_RADIUS_M * np.radians(lat - lat[:, -1:])
    chord = np.hypot(np.diff(east), np.diff(north))
    if (chord <= 0).any():
        raise ValueError("waypoints must differ from their neighbours")
    u = np.concatenate((np.zeros((len(lat), 1)), np.cumsum(chord, axis=1)), axis=1)
    at = np.linspace(0.0, u[:, -1], (u.shape[1] - 1) * per_segment + 1, axis=1)
    segment = np.zeros(at.shape, np.int64)
    for j in range(1, u.shape[1] - 1):
        segment += at >= u[:, j : j + 1]

    def values(y: np.ndarray) -> list[np.ndarray]:
        c = cubics_through(u, y)
        own = c[np.arange(len(c))[:, None], np.minimum(segment, c.shape[1] - 1)]
        return [sum(own[:, :, k] * np.prod(range(k - d + 1, k + 1)) * at ** (k - d) for k in range(d, 4)) for d in range(3)]

    (x, dx, ddx), (y, dy, ddy) = values(east), values(north)
    run = np.concatenate((np.zeros((len(x), 1)), np.cumsum(np.hypot(np.diff(x), np.diff(y)), axis=1)), axis=1)
    speed = np.maximum(dx**2 + dy**2, 1e-9)
    return {
        "s": run[:, -1:] - run,
        "east_m": x,
        "north_m": y,
        "lat": lat[:, -1:] + np.degrees(y / geo.EARTH_RADIUS_M),
        "lon": lon[:, -1:] + np.degrees(x / (geo.EARTH_RADIUS_M * shrink)),
        "track_rad": np.unwrap(np.arctan2(dy, dx), axis=1),
        "curvature": (dx * ddy - dy * ddx) / speed**1.5,
    }


def whole_routes(batches: Iterator[pa.RecordBatch], samples: Callable[[int], int]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Routes of equally many waypoints from batches in order of route_id and place: their rows, and where each waypoint stands there (routes, waypoints).

    A route that a batch breaks off waits for the next. So many routes come together that they have about SAMPLES samples, or one.
    """

    def dealt_out(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        size = np.diff(np.append(starts, table.num_rows))
        for n in np.unique(size).tolist():
            own, step = starts[size == n], max(1, SAMPLES // samples(n))
            for k in range(0, len(own), step):
                yield table, own[k : k + step, None] + np.arange(n)

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        if not table.num_rows:
            continue
        ids = pc.dictionary_encode(table.column("route_id"), null_encoding="encode").combine_chunks().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        yield from dealt_out(table.slice(0, starts[-1]), starts[:-1])
        rest = table.slice(starts[-1])
    if rest is not None:
        yield from dealt_out(rest.combine_chunks(), np.zeros(1, np.int64))


def by_route(waypoints: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *more: str) -> DataFrame:
    own = waypoints.select(F.col("route_id").cast("long").alias("route_id"), "place", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *more)
    return dealt(own, "route_id").sortWithinPartitions("route_id", "place").mapInArrow(each, schema)


def reference_paths(waypoints: DataFrame, per_segment: int = 48) -> DataFrame:
    """Samples of the smooth path through each route's waypoints (route_id, place, lat, lon), in order of place.

    The plane is about the last waypoint. Neighbouring waypoints that coincide are an error.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_routes(batches, lambda n: (n - 1) * per_segment + 1):
            lat, lon = (table.column(c).to_numpy()[at] for c in ("lat", "lon"))
            made = sampled_paths(lat, lon, per_segment)
            routes, size = made["s"].shape
            ids = table.column("route_id").combine_chunks().take(pa.array(np.repeat(at[:, 0], size)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(size, dtype=np.int32), routes)), *(pa.array(v.ravel()) for v in made.values())], ["route_id", "idx", *made])

    return by_route(waypoints, each, SAMPLES_OF)


def waypoint_distances(waypoints: DataFrame, samples: DataFrame | None = None, per_segment: int = 48) -> DataFrame:
    """Per route and identifier the distance to go of the sample nearest in degrees (the first of equal ones); a repeated identifier takes its last place.

    Without samples they are those of reference_paths, looked at where they are made: waypoints alone are shuffled.
    """
    if samples is None:
        return _own_distances(waypoints, per_segment)
    last = waypoints.withColumn("rank", F.row_number().over(Window.partitionBy("route_id", "identifier").orderBy(F.desc("place")))).where("rank = 1")
    # Samples out of a Python function are many more than Spark's guess, which must not make it broadcast them.
    pairs = last.hint("merge").join(samples.select("route_id", "idx", "s", F.col("lat").alias("a"), F.col("lon").alias("b")), "route_id")
    near = F.min(F.struct(F.hypot(F.col("a") - F.col("lat"), F.col("b") - F.col("lon")).alias("d"), "idx", "s"))
    return pairs.groupBy("route_id", "identifier").agg(near.alias("n")).select("route_id", "identifier", F.col("n.s").alias("s"))


def _own_distances(waypoints: DataFrame, per_segment: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_routes(batches, lambda n: (n - 1) * per_segment + 1):
            lat, lon = (table.column(c).to_numpy()[at] for c in ("lat", "lon"))
            made = sampled_paths(lat, lon, per_segment)
            names = table.column("identifier").combine_chunks()
            name = pc.dictionary_encode(names, null_encoding="encode").indices.to_numpy()[at]
            for j in range(at.shape[1]):
                last = ~(name[:, j + 1 :] == name[:, j : j + 1]).any(1)
                near = np.hypot(made["lat"] - lat[:, j : j + 1], made["lon"] - lon[:, j : j + 1]).argmin(1)
                rows = pa.array(at[last, j])
                s = made["s"][np.arange(len(at)), near][last]
                yield pa.RecordBatch.from_arrays([table.column("route_id").combine_chunks().take(rows), names.take(rows), pa.array(s)], ["route_id", "identifier", "s"])

    return by_route(waypoints, each, "route_id long, identifier string, s double", "identifier")


PATH = ("east_m", "north_m", "track_rad", "curvature")


def along(samples: DataFrame, wanted: DataFrame, slots: int = 4) -> DataFrame:
    """wanted (route_id, s and anything else) with the path's position, track, curvature and left normal at s: ref_east_m and so on.

    An as-of join: states and samples are sorted together by route and s, and each state takes the line between the
    last sample at or before it and the first at or after it; beyond the ends the path's end holds. Tracks turn the short
    way between samples and are wrapped, whether samples wrap theirs or not. The states of a route are dealt to
    `slots` tasks, each with all samples of the route, so there is one shuffle, and memory does not grow with either.
    A route without samples, or a null s, gives nulls; repeated states each give a row. Samples of a route differ in s.
    """
    point = F.struct("s", *PATH)
    dealt = F.pmod(F.xxhash64(*wanted.columns), F.lit(slots)).cast("int")
    states = wanted.select("route_id", F.col("s").alias("at_"), dealt.alias("slot_"), F.struct(*wanted.columns).alias("state_"), F.lit(None).cast(samples.select(point.alias("x")).schema["x"].dataType).alias("sample_"))
    marks = samples.where("s is not null").select("route_id", F.col("s").alias("at_"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot_"), F.lit(None).cast(states.schema["state_"].dataType).alias("state_"), point.alias("sample_"))
    by = Window.partitionBy("route_id", "slot_")
    # At one distance a sample comes before a state, in either direction.
    kind = F.col("state_").isNotNull()
    side = lambda way: F.last("sample_", True).over(by.orderBy(way, kind).rowsBetween(Window.unboundedPreceding, 0))
    met = states.unionByName(marks).withColumns({"before_": side(F.asc("at_")), "after_": side(F.desc("at_"))}).where(kind)
    a, b = F.coalesce("before_", "after_"), F.coalesce("after_", "before_")
    known = F.col("at_").isNotNull()
    line = lambda y0, y1: F.when(known, interp.between(a["s"], y0, b["s"], y1, F.col("at_")))
    turned = a["track_rad"] + geo.wrap_rad(b["track_rad"] - a["track_rad"])
    found = {f"ref_{c}": geo.wrap_rad(line(a[c], turned)) if c == "track_rad" else line(a[c], b[c]) for c in PATH}
    out = met.select("state_.*", *(v.alias(n) for n, v in found.items()))
    return out.withColumns({"normal_east": 0.0 - F.sin("ref_track_rad"), "normal_north": F.cos("ref_track_rad")})


def on_path(samples: DataFrame, states: DataFrame) -> DataFrame:
    """states (route_id, s, cross_track_m, heading_offset_rad and others) with their position and heading: east_m, north_m, psi_rad, beside what along() gives."""
    met = along(samples, states)
    east = F.col("ref_east_m") + F.col("cross_track_m") * F.col("normal_east")
    north = F.col("ref_north_m") + F.col("cross_track_m") * F.col("normal_north")
    return met.withColumns({"east_m": east, "north_m": north, "psi_rad": geo.wrap_rad(F.col("ref_track_rad") + F.col("heading_offset_rad"))})


def lateral_command(states: DataFrame, wind_east: float = 0.0, wind_north: float = 0.0, lookahead_m: float = 1500.0, cross_gain: float = 1.0, track_gain: float = 2.0) -> DataFrame:
    """states (ref_* of along(), east_m, north_m, psi_rad, v_tas, bank_limit) with cross_track_m, track_error_rad and bank_rad.

    Feedback on cross-track and track error corrects the path's curvature; the bank that turns so is limited.
    """
    ve, vn = F.col("v_tas") * F.cos("psi_rad") + wind_east, F.col("v_tas") * F.sin("psi_rad") + wind_north
    out = states.withColumns({"ground_speed": F.hypot(ve, vn), "track_error_rad": geo.wrap_rad(F.atan2(vn, ve) - F.col("ref_track_rad"))})
    cross = -(F.col("east_m") - F.col("ref_east_m")) * F.sin("ref_track_rad") + (F.col("north_m") - F.col("ref_north_m")) * F.cos("ref_track_rad")
    out = out.withColumn("cross_track_m", cross)
    look = max(1.0, lookahead_m)
    curvature = F.col("ref_curvature") - cross_gain * F.col("cross_track_m") / look**2 - track_gain * F.col("track_error_rad") / look
    bank = F.atan(F.pow(F.greatest("ground_speed", F.lit(1.0)), F.lit(2.0)) * curvature / flight.G0)
    return out.withColumn("bank_rad", F.greatest(F.least(bank, F.col("bank_limit")), -F.col("bank_limit")))
