"""Trajectory compression: breakpoints by recursive distance splitting, per flight.

A flight may be of any length. Flights of up to SMALL points are finished at once, many to a batch. For longer
ones every round finds the first largest error of each open span by an aggregation; spans of up to SMALL points are
then finished likewise, and the points of larger ones go to the two new spans, in a table in the shared folder, until no large span splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.shared import dealt, forget, written

# Bits of a breakpoint's kinds.
LATERAL, ALTITUDE = 1, 2
EARTH_RADIUS_M = 6_371_000.0
#: Points of a span that one task may hold.
SMALL = 4096


def breakpoints(n: int, errors: Callable[[int, int], np.ndarray], tolerance: float) -> np.ndarray:
    """Marks of kept points: a span splits at its first largest error while that is above the tolerance.

    errors(a, b) gives the error of each point strictly between a and b.
    """
    keep = np.zeros(n, bool)
    if n:
        keep[[0, -1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        e = errors(a, b)
        worst = int(np.argmax(e))
        if e[worst] > tolerance:
            at = a + 1 + worst
            keep[at] = True
            todo += [(a, at), (at, b)]
    return keep


def spatial_breakpoints(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Errors are distances to the line through the span's ends (to the point, if they coincide)."""

    def errors(a: int, b: int) -> np.ndarray:
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = np.sqrt(dx * dx + dy * dy)
        return np.sqrt(px * px + py * py) if length == 0 else np.abs(dx * py - dy * px) / length

    return breakpoints(len(x), errors, tolerance)


def series_breakpoints(t: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Errors are differences from the value interpolated in t (the first value, if the ends share t)."""

    def errors(a: int, b: int) -> np.ndarray:
        slope = 0.0 if t[b] == t[a] else (y[b] - y[a]) / (t[b] - t[a])
        return np.abs(y[a + 1 : b] - (y[a] + slope * (t[a + 1 : b] - t[a])))

    return breakpoints(len(t), errors, tolerance)


def _finish(tolerances: dict[int, float]) -> Callable[[pd.DataFrame], np.ndarray]:
    """Which rows to mark inside whole spans of at most SMALL points in all, whose ends each row carries.

    Rows are in order of span, t and o. All open spans split together, round by round.
    """

    def one(rows: pd.DataFrame) -> np.ndarray:
        span = rows["span"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1])))
        size = np.diff(np.append(first, len(rows)))
        # Each span's points stand between its two ends.
        a = first + 2 * np.arange(len(first))
        b = a + size + 1
        inner = np.arange(len(rows)) + 2 * np.repeat(np.arange(len(first)), size) + 1
        u, v = np.empty(len(rows) + 2 * len(first)), np.empty(len(rows) + 2 * len(first))
        for x, c in ((u, "u"), (v, "v")):
            x[inner], x[a], x[b] = rows[c].to_numpy(), rows[f"a{c}"].to_numpy()[first], rows[f"z{c}"].to_numpy()[first]
        lateral = rows["kind"].to_numpy()[first] == LATERAL
        keep = np.zeros(len(u), bool)
        while len(a):
            open_ = b - a > 1
            a, b, lateral = a[open_], b[open_], lateral[open_]
            if not len(a):
                break
            size = b - a - 1
            edge = np.cumsum(size) - size
            of = np.repeat(np.arange(len(a)), size)
            at = np.arange(len(of)) - edge[of] + a[of] + 1
            dx, dy = u[b] - u[a], v[b] - v[a]
            px, py = u[at] - u[a][of], v[at] - v[a][of]
            with np.errstate(divide="ignore", invalid="ignore"):
                length, slope = np.sqrt(dx * dx + dy * dy), np.where(dx == 0, 0.0, dy / dx)
                across = np.where(length[of] == 0, np.sqrt(px * px + py * py), np.abs(dx[of] * py - dy[of] * px) / length[of])
            e = np.where(lateral[of], across, np.abs(v[at] - (v[a][of] + slope[of] * px)))
            worst = np.maximum.reduceat(e, edge)
            split = worst > np.where(lateral, tolerances[LATERAL], tolerances[ALTITUDE])
            largest = np.flatnonzero((e == worst[of]) & split[of])[::-1]
            middle = np.zeros(len(a), np.int64)
            middle[of[largest]] = at[largest]  # the first of equal ones is written last
            a, b, lateral, middle = a[split], b[split], lateral[split], middle[split]
            keep[middle] = True
            a, b, lateral = np.concatenate((a, middle)), np.concatenate((middle, b)), np.concatenate((lateral, lateral))
        return keep[inner]

    return one


#: A span: its flight, kind and first point.
KEY = ["flight_id", "kind", "at", "ao"]
MARK = ["flight_id", "kind", "t", "o", "lat", "lon", "geoaltitude"]


def _finish_spans(spans: DataFrame, finish: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Marks of whole spans. Many small ones share a batch; the last of a batch waits for its rows in the next."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def marked(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            edges, keep, i = np.append(starts, len(rows)), [], 0
            rows = rows.assign(span=np.repeat(np.arange(len(starts)), np.diff(edges)))
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + SMALL, side="right")) - 1)
                keep.append(finish(rows.iloc[edges[i] : edges[j]]))
                i = j
            return rows.loc[np.concatenate(keep), MARK]

        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            new = np.ones(len(rows), bool)
            new[1:] = np.any([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in KEY], axis=0)
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield marked(rows.iloc[: starts[-1]], starts[:-1])
            rest = rows.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else rest
        if rest is not None and len(rest):
            yield marked(rest, np.array([0]))

    return dealt(spans, *KEY).sortWithinPartitions(*KEY, "t", "o").mapInPandas(each, "flight_id string, kind int, t long, o long, lat double, lon double, geoaltitude double")


def compress(tracks: DataFrame, lateral_m: float = 100.0, altitude_m: float = 50.0) -> DataFrame:
    """Kept rows (flight_id, time, lat, lon, geoaltitude, mask) of complete tracks (flight_id, time, ordinal, lat, lon, geoaltitude).

    mask: 1 lateral breakpoint, 2 altitude breakpoint, 3 both. Time and ordinal are unique in a flight.
    """
    rows = tracks.select("flight_id", F.col("time").cast("long").alias("t"), F.col("ordinal").cast("long").alias("o"), "lat", "lon", "geoaltitude")
    point = F.struct("t", "o", "lat", "lon", "geoaltitude")
    # Sums of integers: the plane about the means is the same however rows are dealt.
    mean = lambda c: F.sum(F.round(F.col(c) * 1e7).cast("long")) / F.count("*") / 1e7
    flights = written(rows.groupBy("flight_id").agg(F.min(point).alias("first"), F.max(point).alias("last"), mean("lat").alias("lat0"), mean("lon").alias("lon0"), F.count("*").alias("n")), "flights")

    def plane(kind: int, lat: Column, lon: Column, t: Column, altitude: Column) -> tuple[Column, Column]:
        if kind == ALTITUDE:
            return t.cast("double"), altitude.cast("double")
        return EARTH_RADIUS_M * F.cos(F.radians("lat0")) * F.radians(lon - F.col("lon0")), EARTH_RADIUS_M * F.radians(lat - F.col("lat0"))

    inner = rows.join(flights, "flight_id").where(F.struct("t", "o") > F.struct("first.t", "first.o")).where(F.struct("t", "o") < F.struct("last.t", "last.o"))
    spans = None
    for kind in (LATERAL, ALTITUDE):
        names = {"": "", "a": "first.", "z": "last."}
        places = {f"{p}{c}": e for p, at in names.items() for c, e in zip("uv", plane(kind, *(F.col(f"{at}{c}") for c in ("lat", "lon", "t", "geoaltitude"))))}
        part = inner.select("flight_id", F.lit(kind).alias("kind"), "t", "o", "lat", "lon", "geoaltitude", F.col("first.t").alias("at"), F.col("first.o").alias("ao"), *(e.alias(n) for n, e in places.items()), "n")
        spans = part if spans is None else spans.unionByName(part)

    tolerances = {LATERAL: lateral_m, ALTITUDE: altitude_m}
    dx, dy = F.col("zu") - F.col("au"), F.col("zv") - F.col("av")
    px, py = F.col("u") - F.col("au"), F.col("v") - F.col("av")
    length = F.sqrt(dx * dx + dy * dy)
    across = F.when(length == 0, F.sqrt(px * px + py * py)).otherwise(F.abs(dx * py - dy * px) / length)
    above = F.abs(F.col("v") - (F.col("av") + F.when(dx == 0, 0.0).otherwise(dy / dx) * px))
    limit = F.when(F.col("kind") == LATERAL, F.lit(lateral_m)).otherwise(F.lit(altitude_m))
    ends = [flights.select("flight_id", F.lit(LATERAL | ALTITUDE).alias("kind"), f"{e}.*").select(*MARK) for e in ("first", "last")]
    finish = _finish(tolerances)
    # Short flights need no round.
    marks = ends[0].unionByName(ends[1]).unionByName(written(_finish_spans(spans.where(F.col("n") <= SMALL).drop("n"), finish), "marks"))
    long = (flights.agg(F.max("n")).first()[0] or 0) > SMALL
    spans = written(spans.where(F.col("n") > SMALL).drop("n"), "spans")
    while long:
        # The first largest error of each span, and whether its points fit in a task.
        worst = F.max(F.struct(F.when(F.col("kind") == LATERAL, across).otherwise(above).alias("e"), (-F.col("t")).alias("t"), (-F.col("o")).alias("o"), "u", "v", "lat", "lon", "geoaltitude"))
        found = written(spans.groupBy(*KEY).agg(worst.alias("m"), F.count("*").alias("size")).where(F.col("m.e") > limit), "splits")
        small = spans.join(found.where(F.col("size") <= SMALL).select(*KEY), KEY)
        marks = marks.unionByName(written(_finish_spans(small, finish), "marks"))
        large = found.where(F.col("size") > SMALL).select(*KEY, (-F.col("m.t")).alias("mt"), (-F.col("m.o")).alias("mo"), F.col("m.u").alias("mu"), F.col("m.v").alias("mv"), "m.lat", "m.lon", "m.geoaltitude")
        if not large.head(1):
            break
        marks = marks.unionByName(large.select("flight_id", "kind", F.col("mt").alias("t"), F.col("mo").alias("o"), "lat", "lon", "geoaltitude"))
        before = F.struct("t", "o") < F.struct("mt", "mo")
        joined = spans.join(large.select(*KEY, "mt", "mo", "mu", "mv"), KEY).where(F.struct("t", "o") != F.struct("mt", "mo"))
        moved = {f"{p}{c}": F.when(before if p == "z" else ~before, F.col(f"m{c}")).otherwise(F.col(f"{p}{c}")).alias(f"{p}{c}") for p, cs in (("a", "touv"), ("z", "uv")) for c in cs}
        spans, done = written(joined.select(*MARK, "u", "v", *moved.values()), "spans"), spans
        forget(done)
    forget(spans)
    return marks.groupBy("flight_id", "t", "o").agg(F.bit_or("kind").alias("mask"), *(F.min(c).alias(c) for c in ("lat", "lon", "geoaltitude"))).select("flight_id", F.col("t").alias("time"), "lat", "lon", "geoaltitude", "mask")


def compressed_flights(tracks: DataFrame, kept: DataFrame, lateral_m: float = 100.0, altitude_m: float = 50.0) -> DataFrame:
    """One row per flight: points, breakpoint times by kind, counts and tolerances."""
    raw = tracks.groupBy("flight_id").agg(F.min(F.struct("time", "ordinal", "callsign", "icao24")).alias("first"), F.min("time").cast("long").alias("first_time"), F.max("time").cast("long").alias("last_time"), F.count("*").alias("raw_point_count"))
    times = lambda bit: F.array_sort(F.collect_list(F.when(F.col("mask").bitwiseAND(F.lit(bit)) > 0, F.col("time"))))
    points = F.array_sort(F.collect_list(F.struct("time", "lat", "lon", F.col("geoaltitude").alias("geoaltitude_m"), F.col("mask").alias("breakpoint_mask"))))
    by = kept.groupBy("flight_id").agg(points.alias("points"), times(LATERAL).alias("lateral_breakpoint_times"), times(ALTITUDE).alias("altitude_breakpoint_times"), F.count("*").alias("compressed_point_count"))
    joined = raw.join(by, "flight_id")
    return joined.select("flight_id", "first.callsign", "first.icao24", "points", "lateral_breakpoint_times", "altitude_breakpoint_times", "first_time", "last_time", "raw_point_count", "compressed_point_count", F.lit(lateral_m).alias("lateral_tolerance_m"), F.lit(altitude_m).alias("altitude_tolerance_m"))


def resampled(samples: DataFrame, starts: DataFrame) -> DataFrame:
    """Samples at offsets from a start as tracks for compress(): whole seconds, rounded half to even, the last sample of equal times kept.

    samples: flight_id, idx, t, lat, lon, h; starts: flight_id, callsign, icao24, seed_time. A flight without a
    start, a sample without a place, height or offset, and a null flight are left out.
    """
    time = F.rint(F.col("seed_time") + F.col("t")).cast("long")
    placed = samples.dropna(subset=["t", "lat", "lon", "h"]).join(starts, "flight_id")
    rows = placed.select("flight_id", "callsign", "icao24", time.alias("time"), "lat", "lon", F.col("h").alias("geoaltitude"), F.col("idx").cast("long").alias("ordinal"))
    latest = F.max_by(F.struct("callsign", "icao24", "lat", "lon", "geoaltitude", "ordinal"), "ordinal").alias("last")
    return rows.where("time is not null").groupBy("flight_id", "time").agg(latest).select("flight_id", "last.callsign", "last.icao24", "time", "last.lat", "last.lon", "last.geoaltitude", "last.ordinal")
