"""Tables from files: hourly position files, runway, fix and catalog tables, and compressed flights.

Readers give a schema, so nothing is inferred by a pass over the data. Rows carry `ordinal`, the order of
files and rows, where a later step needs to know which came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars

# Columns of hourly files, and fields of the event and sequence tables.
TRACK = ["time", "icao24", "lat", "lon", "heading", "callsign", "geoaltitude"]
NUMBERS = ["time", "lat", "lon", "heading", "geoaltitude"]
EVENT_COLUMNS = ["date", "flight_id", "callsign", "icao24", "operation", "runway", "event_time", "event_time_utc"]
SEQUENCE_COLUMNS = ["date", "flight_id", "callsign", "icao24", "first_time", "last_time", "fix_sequence", "fix_count"]


def file_order() -> Column:
    """Sorts rows just read from files by file and place in it; Spark deals out parts of files by size, not in order."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def tracks(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Rows of all headerless files named by digits and .csv; bad numbers become null, texts are trimmed."""
    schema = ", ".join(f"{c} string" for c in TRACK)
    reader = spark.read.schema(schema).option("pathGlobFilter", "[0-9]*.csv").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.csv(folder).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name"), file_order().alias("ordinal"))
    rows = rows.where(F.col("file_name").rlike(r"^[0-9]+\.csv$"))
    sign = scalars.callsign(F.col("callsign"))
    fields = {c: scalars.number(F.trim(c)) for c in NUMBERS} | {"icao24": F.trim("icao24"), "callsign": sign}
    out = rows.withColumns(fields)
    return out.select(*TRACK, scalars.flight_id(F.col("callsign"), F.col("icao24")).alias("flight_id"), "source_file", "ordinal")


def require_tracks(found: DataFrame) -> DataFrame:
    if found.isEmpty():
        raise FileNotFoundError("no hourly position files")
    return found


def table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A table with a header, all columns as text; missing columns are an error that lists them in order."""
    found = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(found.columns))
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return found


def runway_thresholds(wide: DataFrame) -> DataFrame:
    """Both ends of each runway pair as rows (runway, runway_pair, place_lat, place_lon, place_ord), in order of runway."""
    ends = wide.select(F.trim("runway_pair").alias("runway_pair"), F.split(F.trim("runway_pair"), "/").alias("names"), *(F.col(c).try_cast("double").alias(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")))
    two = F.array(*(F.struct(F.trim(F.get("names", F.lit(i))).alias("runway"), F.col(f"latitude_{e}").alias("place_lat"), F.col(f"longitude_{e}").alias("place_lon")) for i, e in enumerate("ab")))
    rows = ends.select("runway_pair", F.inline(two))
    # A table of runways: a few rows an airport.
    return rows.select("runway", "runway_pair", "place_lat", "place_lon", F.row_number().over(Window.orderBy("runway")).alias("place_ord"))


def fixes(rows: DataFrame) -> DataFrame:
    """Waypoints and VORs with positions."""
    some = rows.where(F.lower(F.trim("fix_type")).isin("waypoint", "vor"))
    some = some.select(F.trim("identifier").alias("identifier"), F.lower(F.trim("fix_type")).alias("fix_type"), F.col("latitude_deg").cast("string").try_cast("double").alias("place_lat"), F.col("longitude_deg").cast("string").try_cast("double").alias("place_lon"))
    return some.dropna(subset=["place_lat", "place_lon"])


def fix_catalog(rows: DataFrame) -> DataFrame:
    """Upper-case identifier to position and elevation, of rows as `table` reads them; the last row of several counts."""
    ident = F.upper(F.trim("identifier"))
    some = rows.withColumn("row", file_order()).select("row", ident.alias("identifier"), *(F.col(c).cast("string").try_cast("double").alias(c) for c in ("latitude_deg", "longitude_deg", "elevation_ft")))
    some = some.where("identifier <> ''").dropna(subset=["latitude_deg", "longitude_deg"])
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("identifier").orderBy(F.desc("row")))).where("rank = 1").drop("rank", "row")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events; event_time must be a number in every row."""
    found = table(spark, path, EVENT_COLUMNS)
    trimmed = found.select(*(F.trim(c).alias(c) for c in found.columns))
    return trimmed.withColumns({"operation": F.lower("operation"), "event_time": F.col("event_time").cast("double").cast("long")})


def fix_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Fix sequences; times and counts must be present and numbers."""
    found = table(spark, path, SEQUENCE_COLUMNS)
    strict = lambda c: F.coalesce(F.col(c).cast("double").cast("long"), F.raise_error(F.lit(f"{c} is missing")).cast("long"))
    return found.withColumns({"fix_sequence": F.coalesce("fix_sequence", F.lit("")), **{c: strict(c) for c in ("first_time", "last_time", "fix_count")}, "ordinal": file_order()})


COMPRESSED = (
    "flight_id string, callsign string, icao24 string, columns array<string>, breakpoint_mask_bits map<string,int>, points array<array<double>>, "
    "lateral_breakpoint_times array<bigint>, altitude_breakpoint_times array<bigint>, first_time bigint, last_time bigint, raw_point_count int, "
    "compressed_point_count int, lateral_tolerance_m double, altitude_tolerance_m double"
)


def compressed_flights(spark: SparkSession, path: str) -> DataFrame:
    """One JSON flight per line; blank lines are skipped, a missing id is an error, the last of several counts."""
    lines = spark.read.schema(COMPRESSED).option("mode", "FAILFAST").json(path).withColumn("ordinal", file_order())
    named = lines.withColumn("flight_id", F.coalesce("flight_id", F.raise_error(F.lit("a flight has no flight_id"))))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("flight_id").orderBy(F.desc("ordinal")))).where("rank = 1").drop("rank")


def json_object(spark: SparkSession, path: str) -> dict:
    """A single JSON document whose root is an object."""
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.schema_of_variant(F.try_parse_json("value")).alias("kind"), "value").limit(2).collect()
    if len(rows) != 1 or not (rows[0]["kind"] or "").startswith("OBJECT"):
        raise ValueError(f"{path} holds no JSON object")
    import json

    return json.loads(rows[0]["value"])


def authoritative_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog with its full header, with the older one of three columns, or with none; a header row among the rows is dropped."""
    names = ["flight_type", "callsign", "icao24", "event_time"]
    rows = spark.read.schema(", ".join(f"{c} string" for c in names)).option("mode", "PERMISSIVE").csv(path)
    return rows.where(~F.trim("flight_type").eqNullSafe("flight_type"))


def chart_entries(spark: SparkSession, path: str) -> DataFrame:
    """Charts of a manifest {star: [{label: url}], iap: [...]} in order: section, place, label, url, file name."""
    kind = "struct<star: array<map<string,string>>, iap: array<map<string,string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    sections = F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"m.{s}").alias("list")) for s in ("star", "iap")))
    items = rows.select(F.posexplode(sections).alias("section_no", "s")).select("section_no", "s.section", F.posexplode("s.list").alias("place", "entry"))
    one = F.assert_true(F.size("entry") == 1, F.lit("a chart entry must have one label"))
    charts = items.select("section_no", "section", "place", F.explode("entry").alias("label", "url"), one.alias("checked"))
    name = F.url_decode(F.element_at(F.split(F.parse_url("url", F.lit("PATH")), "/"), -1))
    return charts.select("section_no", "section", "place", "label", "url", name.alias("file_name"))


def chart_links(pages: DataFrame, sections: dict[str, tuple[str, str]]) -> DataFrame:
    """(path, section, place, label, url) of archived pages (path, value), each section cut by its heading and end marker.

    Of links with one label and url in a section the first counts; a page without a section has no rows of it.
    """
    html = pages.select("path", scalars.html_part(F.col("value")).alias("html"))
    cut = F.array(*(F.struct(F.lit(n).alias("section"), scalars.section(F.col("html"), *ends).alias("part")) for n, ends in sections.items()))
    return first_links(html.select("path", F.inline(cut)), ["path", "section"], "part")


def first_links(rows: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, place, label, url) of the links in a column, the first of each label and url; blank ones are left out."""
    found = rows.select(*keys, F.posexplode(scalars.anchors(F.col(html), "")).alias("place", "a"))
    named = found.select(*keys, "place", scalars.chart_name(F.col("a.label")).alias("label"), scalars.entities(F.trim("a.url")).alias("url"))
    return named.where("label <> '' and url <> ''").groupBy(*keys, "label", "url").agg(F.min("place").alias("place"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of PDF files in a folder, in order, their suffix in any case; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return rows.select("path", "length").orderBy("path")
