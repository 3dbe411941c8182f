"""Whole runs, from folders of files to result folders: catalog, compression and procedure extraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import catalog, classify, compress, nav, proximity, segments
from trackloom.sources import files, sinks


@dataclass
class Catalog:
    """events: one row per arrival or departure; sequences: one per segment; counts: segments by classification."""

    events: DataFrame
    sequences: DataFrame
    counts: DataFrame


def label_of(folder: str, given: str | None = None) -> str:
    """The given date label, or the folder's own name."""
    return given or folder.rstrip("/").rsplit("/", 1)[-1]


def catalog_of(tracks: DataFrame, thresholds: DataFrame, fixes: DataFrame, date_label: str, *, radius_m: float = 5000.0, fix_radius_m: float = 2000.0, gap_s: float = 1500.0, floor_m: float = 500.0) -> Catalog:
    """Events, fix sequences and counts of all segments of raw tracks.

    Segments without a valid position are unclassified, with an empty sequence and no times.
    """
    split = segments.split_by_gap(tracks, gap_s)
    rows = segments.segment_rows(split)
    every = split.select("source_flight", "segment", "flight_id", "callsign", "icao24").distinct()
    classified = classify.classify(rows, every, thresholds, radius_m, floor_m)
    events = classify.events(classified, date_label).orderBy("event_time", "flight_id")
    found = proximity.fix_sequences(rows, fixes, fix_radius_m).drop("callsign", "icao24")
    sequences = every.join(found, "flight_id", "left").select(
        F.lit(date_label).alias("date"), "flight_id", "callsign", "icao24", F.col("first_time").cast("long").alias("first_time"), F.col("last_time").cast("long").alias("last_time"), F.coalesce("fix_sequence", F.lit("")).alias("fix_sequence"), F.coalesce("fix_count", F.lit(0)).alias("fix_count")
    )
    counts = classified.groupBy("classification").agg(F.count("*").alias("segments"))
    return Catalog(events, sequences.orderBy(F.col("first_time").asc_nulls_last(), "flight_id"), counts)


def build_catalog(spark: SparkSession, folder: str, runways_csv: str, fixes_csv: str, out: str, *, date_label: str | None = None, authoritative_csv: str | None = None, **limits: float) -> Catalog:
    """Reads a folder of hourly files and writes both result tables below out; with an authoritative catalog, the differences too."""
    label = label_of(folder, date_label)
    tracks = files.require_tracks(files.tracks(spark, folder))
    thresholds = files.runway_thresholds(files.table(spark, runways_csv, ["runway_pair", "latitude_a", "longitude_a", "latitude_b", "longitude_b"]))
    rows = files.fixes(files.table(spark, fixes_csv, ["identifier", "fix_type", "latitude_deg", "longitude_deg"]))
    fixes = rows.withColumn("place_ord", F.monotonically_increasing_id())
    made = catalog_of(tracks, thresholds, fixes, label, **limits)
    sinks.csv(made.events, f"{out}/{label}_landings_and_departures")
    sinks.csv(made.sequences, f"{out}/{label}_fix_sequences")
    if authoritative_csv:
        sinks.csv(catalog.difference(made.events, files.authoritative_catalog(spark, authoritative_csv)), f"{out}/{label}_differences")
    return made


def compress_folder(spark: SparkSession, folder: str, out: str, *, catalog_csv: str | None = None, lateral_m: float = 100.0, altitude_m: float = 50.0, gap_s: float = 1500.0) -> DataFrame:
    """Compresses every flight of all hourly files below folder; writes flights, their manifest and the run's totals.

    With an event table only its arrivals and departures are compressed.
    """
    whole = segments.keep_last(files.require_tracks(files.tracks(spark, folder, recursive=True)))
    split = segments.split_by_gap(whole, gap_s).withColumn("ordinal", F.lit(0).cast("long"))
    if catalog_csv:
        split = segments.only_flights(split, segments.arrival_departure_flights(files.table(spark, catalog_csv, ["flight_id", "operation"])))
    flights = compress.compressed_flights(split, compress.compress(split, lateral_m, altitude_m), lateral_m, altitude_m)
    sinks.json_lines(flights, f"{out}/flights")
    written = spark.read.schema(flights.schema).json(f"{out}/flights")
    sinks.csv(sinks.flight_manifest(written), f"{out}/manifest")
    sinks.json_lines(sinks.run_metadata(written, lateral_m, altitude_m).drop("json"), f"{out}/metadata")
    return written


def extract_procedures(spark: SparkSession, records: str, airport: str, out: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Legs and fixes of an airport from a file of records, links other airports' procedures add, and a text report."""
    lines = spark.read.text(records).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    parsed = nav.parse(lines)
    legs = nav.legs(parsed, airport, pattern)
    resolved = nav.resolve(nav.reference_tokens(legs), parsed, airport)
    fixes = nav.fixes(resolved)
    others = parsed.where((F.col("record_type") == "S") & F.col("section_code").isin(*nav.PROCEDURES) & F.col("airport").isNotNull() & (F.col("airport") != airport))
    scope = fixes.where(F.col("fix_type").isin("waypoint", "vor")).select("identifier")
    runs = nav.scoped_runs(others.select("line_no", "airport", *nav.TRANSITION), scope, ["airport", *nav.GROUP])
    kept = runs.join(nav.supplement(runs, nav.links(legs)).select("run"), "run", "left_semi")
    own = legs.withColumns({"part": F.lit(0), "run": F.lit(None).cast(runs.schema["run"].dataType), "place": F.lit(0)})
    added = kept.withColumn("part", F.lit(1)).select(*own.columns)
    all_legs = own.unionByName(added).orderBy("part", "run", "place", "line_no").select(*nav.TRANSITION)
    sinks.csv(all_legs, f"{out}/airport_related")
    sinks.csv(fixes, f"{out}/airport_related_fixes")
    summary = nav.summary(parsed, legs, resolved, pattern or f"SUSAP {airport}*")
    sinks.extraction_report(nav.failures(resolved, parsed, airport), summary, airport).coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return all_legs, fixes
