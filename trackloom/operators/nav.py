"""Airport procedures from fixed-width navigation records, and links between fixes.

A line is parsed into named columns once; dimensions (waypoints, navaids, runways) are filters of that
table, and lookups are joins with an explicit order of preference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars

# Section codes of procedure records, and column places (first, length) of the fields used.
PROCEDURES = ("PD", "PE", "PF")
COMMON = {"record_type": (1, 1), "airport": (7, 4), "icao": (11, 2)}
POINT = {"latitude_raw": (33, 9), "longitude_raw": (42, 10)}
LEG = {
    "sid_star_approach_identifier": (14, 6),
    "route_type": (20, 1),
    "transition_identifier": (21, 5),
    "sequence_number": (27, 3),
    "fix_identifier": (30, 5),
    "icao_code": (35, 2),
    "section_code_2": (37, 2),
    "altitude": (85, 5),
    "altitude_2": (90, 5),
}
TRANSITION = ["section_code", *LEG]
GROUP = ["section_code", "sid_star_approach_identifier", "route_type", "transition_identifier"]


def field(place: tuple[int, int]) -> Column:
    return scalars.clean(F.substring("line", *place))


def parse(lines: DataFrame) -> DataFrame:
    """(line_no, line) with named fields; section_code is null for lines that are no record of a known section.

    Every field is cut from every line; which ones mean something depends on the section.
    """
    area = F.substring("line", 5, 1)
    section = F.when(area == "P", F.concat(area, F.substring("line", 13, 1))).otherwise(F.concat(area, F.trim(F.substring("line", 6, 1))))
    known = F.when(section.isin("PC", "EA", "D", "PG", *PROCEDURES), section)
    named = lines.select("line_no", "line", F.when(F.length("line") >= 40, known).alias("section_code"), *(field(p).alias(n) for n, p in COMMON.items()))
    columns = {n: field(p) for n, p in (LEG | POINT).items()}
    columns["identifier"], columns["elevation_raw"] = field((14, 5)), F.when(section == "PG", field((67, 5)))
    return named.withColumns(columns)


def matches(pattern: str) -> Column:
    """Whether the line fits a pattern with * and ?."""
    return F.col("line").rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def legs(parsed: DataFrame, airport: str, pattern: str | None = None) -> DataFrame:
    """Procedure legs of an airport, in file order by line_no."""
    some = parsed.where(matches(pattern or f"SUSAP {airport}*") & (F.col("record_type") == "S") & F.col("section_code").isin(*PROCEDURES) & (F.col("airport") == airport))
    return some.select("line_no", *TRANSITION)


def reference_tokens(some_legs: DataFrame) -> DataFrame:
    """token and number of legs that name it; a leg that names one twice counts once."""
    both = F.array_distinct(F.filter(F.array("transition_identifier", "fix_identifier"), lambda t: t.isNotNull()))
    return some_legs.select(F.explode(both).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))


@dataclass(frozen=True)
class Table:
    """A table that names are looked up in: order of preference, section, type of what it finds, whether only the airport's
    own records count, whether the last of several in the file counts, and whether the airport is part of what is found."""

    order: int
    section: str
    fix_type: str
    local: bool
    last: bool
    keep_airport: bool


# The tables in order; the first is for runways alone.
TABLES = (Table(0, "PG", "runway", True, True, True), Table(1, "PC", "waypoint", True, True, True), Table(2, "EA", "waypoint", False, False, False), Table(3, "D", "vor", False, False, False), Table(4, "PC", "waypoint", False, False, True))


def resolve(tokens: DataFrame, parsed: DataFrame, airport: str) -> DataFrame:
    """tokens with the fix each one names, or nulls.

    RW tokens look up the airport's runways alone. Others take, in this order: the airport's waypoints, en
    route waypoints, navaids, and waypoints of any airport. Of several records the last counts in tables
    keyed by airport, the first in the others. One scan of the records: each is an entry of every table it fits, and
    the least entry of a name is kept by an aggregation.
    """
    entry = lambda t: F.struct(F.lit(t.order).alias("order"), (-F.col("line_no") if t.last else F.col("line_no")).alias("place"), F.lit(t.fix_type).alias("fix_type"), F.col("section_code"), (F.col("airport") if t.keep_airport else F.lit(None).cast("string")).alias("airport_icao"), F.col("latitude_raw"), F.col("longitude_raw"), F.col("elevation_raw"))
    runway = F.col("identifier").startswith("RW")
    fits = lambda t: (F.col("section_code") == t.section) & (runway == (t.order == 0)) & ((F.col("airport") == airport) if t.local else F.lit(True))
    records = parsed.where(F.col("identifier").isNotNull() & F.col("section_code").isin(*{t.section for t in TABLES}))
    entries = F.filter(F.array(*(F.when(fits(t), entry(t)) for t in TABLES)), lambda e: e.isNotNull())
    best = records.select(F.col("identifier").alias("token"), F.array_min(entries).alias("fix")).where("fix is not null").groupBy("token").agg(F.min("fix").alias("fix"))
    found = tokens.join(best, "token", "left").select("token", "uses", "fix.*").drop("order", "place")
    return found.withColumns({"latitude_deg": scalars.latitude(F.col("latitude_raw")), "longitude_deg": scalars.longitude(F.col("longitude_raw")), "elevation_ft": scalars.elevation_ft(F.col("elevation_raw"))})


def fixes(resolved: DataFrame) -> DataFrame:
    some = resolved.where("fix_type is not null").withColumnsRenamed({"token": "identifier", "section_code": "source_section_code"})
    return some.drop("uses").dropDuplicates(["identifier", "fix_type", "source_section_code", "airport_icao", "latitude_raw", "longitude_raw", "elevation_raw"])


def failures(resolved: DataFrame, parsed: DataFrame, airport: str, shown: int = 5, runways_shown: int = 8) -> DataFrame:
    """Unresolved tokens by number of uses, with airports (in order) that have a record of that name and the reason."""
    most = F.when(F.col("token").startswith("RW"), runways_shown).otherwise(shown)
    other = parsed.where(F.col("section_code").isin("PC", "PG") & F.col("identifier").isNotNull()).groupBy(F.col("identifier").alias("token"))
    other = other.agg(F.array_sort(F.collect_set(F.coalesce("airport", F.lit("unknown")))).alias("airports")).withColumn("airports", F.slice("airports", 1, most))
    lost = resolved.where("fix_type is null").select("token", "uses").join(other, "token", "left")
    reason = F.when(F.col("token") == airport, "airport code, not a fix").when(F.col("airports").isNotNull(), "known at other airports only").otherwise("no record")
    return lost.select("token", "uses", F.when(F.col("token").startswith("RW"), "runway").otherwise("named").alias("kind"), F.coalesce(F.array_join("airports", ","), F.lit("")).alias("airports"), reason.alias("reason"))


def failure_samples(parsed: DataFrame, pattern: str, shown: int = 10) -> DataFrame:
    """The first lines, in file order, that fit a pattern but are no record of a known section."""
    return parsed.where(matches(pattern) & F.col("section_code").isNull()).select("line_no", "line").orderBy("line_no").limit(shown)


def summary(parsed: DataFrame, some_legs: DataFrame, resolved: DataFrame, pattern: str) -> DataFrame:
    """One row of counts of an extraction."""
    hits = parsed.agg(F.count_if(matches(pattern)).alias("filter_hits"), F.count_if(matches(pattern) & F.col("section_code").isNull()).alias("parse_failures"))
    lost = F.col("fix_type").isNull()
    same = F.struct("token", "fix_type", "section_code", "airport_icao", "latitude_raw", "longitude_raw", "elevation_raw")
    fixed = resolved.agg(F.coalesce(F.sum(F.when(lost, F.col("uses"))), F.lit(0)).alias("unresolved_references"), F.count_if(lost).alias("unresolved_identifiers"), F.count("fix_type").alias("resolved"), F.count_distinct(F.when(~lost, same)).alias("fixes_added"))
    counted = some_legs.agg(F.count("*").alias("legs")).crossJoin(hits).crossJoin(fixed)
    return counted.select("filter_hits", "legs", "fixes_added", "unresolved_references", "unresolved_identifiers", "parse_failures", (F.col("resolved") - F.col("fixes_added")).alias("duplicates"))


def ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(scalars.sequence_number(F.col("sequence_number")), "line_no")


def links(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct (from_fix, to_fix) of neighbours in sequence within each group; a row without a fix breaks the chain."""
    own = rows.withColumn("before", F.lag("fix_identifier").over(ordered(keys or GROUP)))
    return own.where("fix_identifier is not null and before is not null").select(F.col("before").alias("from_fix"), F.col("fix_identifier").alias("to_fix")).distinct()


def scoped_runs(rows: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of at least two rows whose fixes are all in scope (a table of identifier), renumbered 010, 020, ...

    Adds run (the line of its first row, which orders runs as the file does) and place, from 1.
    """
    some = rows.join(scope.select(F.col("identifier").alias("fix_identifier"), F.lit(1).alias("inside")), "fix_identifier", "left")
    order = ordered(keys)
    some = some.withColumns({"outside": F.sum(F.when(F.col("inside").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)), "group_line": F.min("line_no").over(Window.partitionBy(*keys))})
    held = some.where("inside is not null")
    island = [*keys, "outside"]
    numbered = held.withColumns({"place": F.row_number().over(ordered(island)), "size": F.count("*").over(Window.partitionBy(*island))})
    runs = numbered.where("size >= 2")
    return runs.withColumn("sequence_number", F.format_string("%03d", F.col("place") * 10)).withColumn("run", F.struct("group_line", "outside")).drop("inside", "outside", "group_line", "size")


def supplement(runs: DataFrame, base: DataFrame) -> DataFrame:
    """Runs that add a link which neither base nor an earlier run has, and each one's number of such links.

    A run that is passed over has no new link, so an earlier run counts whether it was kept or not, and every
    link belongs to the first run that has it. That needs no sequential pass.
    """
    own = runs.withColumn("before", F.lag("fix_identifier").over(Window.partitionBy("run").orderBy("place")))
    pairs = own.where("before is not null").select("run", F.col("before").alias("from_fix"), F.col("fix_identifier").alias("to_fix")).distinct()
    first = pairs.groupBy("from_fix", "to_fix").agg(F.min("run").alias("run")).join(base, ["from_fix", "to_fix"], "left_anti")
    return first.groupBy("run").agg(F.count("*").alias("new_links"))
