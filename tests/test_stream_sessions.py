"""Streams read a table on disk, a file or a folder of part files, to its end, the last sessions and rows included."""

import datetime
import random

import pytest

from trackloom.operators import segments
from trackloom.plans import fixture
from trackloom.plans.queries import QUERIES, drained
from trackloom.streaming import tracks as streams

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_rows(n=300, seed=6):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=rng.choice([rng.randrange(86_400), rng.randrange(20) * 3_600])), rng.randrange(6), "x", float(i % 40), "{}") for i in range(1, n + 1)]
    return rows + [(n + 1, start, None, None, None, None)]


@pytest.mark.parametrize("parts, files", [(1, 64), (9, 2)])
def test_folders_equal_plain_tables(spark, tmp_path, parts, files):
    """Part files in several micro-batches, in no order of time, then a restart from the checkpoint."""
    spark.createDataFrame(event_rows(), EVENTS).repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    plain = sorted(map(tuple, segments.keep_last(fixture.tracks(spark, d)).where("flight_id is not null").select("flight_id", "time", "ordinal", "geoaltitude").collect()))
    kept = drained(spark, d, lambda s: streams.keep_last(fixture.as_tracks(s), "36500 days"), files).where("flight_id is not null")
    assert sorted(map(tuple, kept.select("flight_id", "time", "ordinal", "geoaltitude").collect())) == plain
    assert len(plain) < 290

    by = {}
    for _, ts, user, *_ in event_rows():
        by.setdefault(user, []).append(ts)
    sessions = []
    for user, times in by.items():
        times.sort()
        opened = [times[0]]
        for before, ts in zip(times, times[1:]):
            if ts - before > datetime.timedelta(hours=8):
                sessions.append((user, opened[0], len(opened)))
                opened = []
            opened.append(ts)
        sessions.append((user, opened[0], len(opened)))
    found = QUERIES["stream_sessions"](spark, d).select("user_id", "start", "rows").collect()
    assert sorted(map(tuple, found), key=str) == sorted(sessions, key=str)


def test_rows_past_the_watermark_are_late(spark, tmp_path):
    """A micro-batch an hour later moves the watermark; a row of the first second that comes after it changes nothing."""
    base = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    steps = [[(1, base, 1, "x", 1.0, "{}"), (3, base, 1, "x", 3.0, "{}"), (2, base, 1, "x", 2.0, "{}")], [(10, base + hour, 1, "x", 1.0, "{}")], [(11, base, 1, "x", 9.0, "{}"), (12, base + 3 * hour, 2, "x", 1.0, "{}")]]
    stream = streams.table(spark, _folder(spark, tmp_path), spark.createDataFrame([], EVENTS).schema)
    out, seen = streams.keep_last(fixture.as_tracks(stream), "10 minutes"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    try:
        for step in steps:
            spark.createDataFrame(step, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run = out.writeStream.format("parquet").option("path", seen).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(r.ordinal for r in spark.read.parquet(seen).collect()) == [3, 10]


def _folder(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        streams.table(spark, str(tmp_path / "none.parquet"), spark.createDataFrame([], EVENTS).schema)



def test_sessions_equal_plain_ones_and_pass_no_memory_sink(spark, tmp_path):
    rows = [(i, 3_600 * h, u) for i, (u, h) in enumerate([(1, 0), (1, 7), (1, 30), (2, 2), (2, 10), (3, 31)])]
    source = spark.createDataFrame(rows, "event_id long, s long, user_id long")
    source.selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) as ts", "user_id", "'x' as event_type", "1.0D as value", "'{}' as props").coalesce(1).write.parquet(str(tmp_path / "made"))
    part = next((tmp_path / "made").glob("part-*.parquet"))
    (tmp_path / "in").mkdir()
    part.rename(tmp_path / "in" / "events.parquet")

    found = QUERIES["stream_sessions"](spark, str(tmp_path / "in"))
    assert sorted((r.user_id, r.start.day, r.start.hour, r["rows"]) for r in found.collect()) == [(1, 1, 0, 2), (1, 2, 6, 1), (2, 1, 2, 2), (3, 2, 7, 1)]
    assert found.inputFiles() and not [t.name for t in spark.catalog.listTables() if t.name.startswith("sessions_")]


def test_keep_last_keeps_state_without_python(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS event_id", "value AS user_id", "'x' AS event_type", "1.0D AS value", "timestamp AS ts")
    plan = streams.keep_last(fixture.as_tracks(stream))._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "Python" not in plan
