"""Compression of flights that no task holds whole."""

import random

import numpy as np
import pytest

from trackloom.operators import compress


@pytest.mark.parametrize("small", [4, 4096])
def test_spans_of_any_length_against_the_recursion(spark, monkeypatch, small):
    rng = random.Random(8)
    rows = [(f, 10 * i, i, 32 + rng.random() / 10, -97 + rng.random() / 10, 1000 * rng.random()) for f, n in (("A1", 40), ("B2", 12), ("C3", 2), ("D4", 1)) for i in range(n)]
    monkeypatch.setattr(compress, "SMALL", small)
    found = compress.compress(spark.createDataFrame(rows, "flight_id string, time long, ordinal long, lat double, lon double, geoaltitude double"), 3000.0, 400.0)
    want = []
    for f in ("A1", "B2", "C3", "D4"):
        own = [r for r in rows if r[0] == f]
        t, lat, lon, h = (np.array([r[c] for r in own], float) for c in (1, 3, 4, 5))
        x = 6_371_000.0 * np.cos(np.radians(lat.mean())) * np.radians(lon - lon.mean())
        mask = compress.spatial_breakpoints(x, 6_371_000.0 * np.radians(lat - lat.mean()), 3000.0) + 2 * compress.series_breakpoints(t, h, 400.0)
        want += [(f, r[1], r[3], r[4], r[5], int(m)) for r, m in zip(own, mask) if m]
    assert sorted(map(tuple, found.collect())) == sorted(want) and 10 < len(want) < len(rows)


def test_a_task_gets_no_more_than_small_points(spark, monkeypatch, tmp_path):
    log, plain = tmp_path / "sizes", compress._finish

    def noted(tolerances):
        inner = plain(tolerances)

        def one(rows):
            with open(log, "a") as f:
                f.write(f"{len(rows)}\n")
            return inner(rows)

        return one

    monkeypatch.setattr(compress, "_finish", noted)
    monkeypatch.setattr(compress, "SMALL", 12)
    rng = random.Random(9)
    rows = [("A1", i, i, 32 + rng.random() / 10, -97.0, 1000 * rng.random()) for i in range(40)]
    compress.compress(spark.createDataFrame(rows, "flight_id string, time long, ordinal long, lat double, lon double, geoaltitude double"), 500.0, 300.0).collect()
    assert max(map(int, log.read_text().split())) <= 12


def test_spans_of_a_batch_split_together():
    """Many spans of both kinds at once keep what each keeps alone, first ones of equal errors included."""
    import pandas as pd

    rng, frames, want = np.random.default_rng(4), [], []
    for k in range(120):
        n, kind = int(rng.integers(3, 12)), int(rng.integers(1, 3))
        u, v = (np.arange(n) * 1.0 if kind == compress.ALTITUDE else rng.integers(0, 4, n) * 1.0), rng.integers(0, 4, n) * 1.0
        frames.append(pd.DataFrame({"span": k, "kind": kind, "u": u[1:-1], "v": v[1:-1], "au": u[0], "av": v[0], "zu": u[-1], "zv": v[-1]}))
        want += (compress.spatial_breakpoints if kind == compress.LATERAL else compress.series_breakpoints)(u, v, 0.9)[1:-1].tolist()
    assert compress._finish({1: 0.9, 2: 0.9})(pd.concat(frames, ignore_index=True)).tolist() == want
