"""Column functions over text, time and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors.
FOOT_M = 0.3048
KNOT_MPS = 0.514444
FPM_MPS = 0.00508


def number(text: Column) -> Column:
    """A DOUBLE, or null where the text is none; NaN becomes null too."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def callsign(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def flight_id(sign: Column, icao24: Column) -> Column:
    """The call sign, or UNKNOWN_ where it is blank, before the address."""
    return F.concat(F.when(sign == "", "UNKNOWN_").otherwise(sign), icao24)


def segment_id(sign: Column, ordinal: Column, icao24: Column) -> Column:
    return F.concat(sign, F.lit("M"), ordinal.cast("string"), icao24)


def base_callsign(value: Column) -> Column:
    """Without a trailing segment mark M and digits."""
    return F.regexp_replace(F.trim(value), r"M\d+$", "")


def segment_mark(sign: Column) -> Column:
    """struct(base, segment) of a call sign that may end in M1 or M2; M2 if it does not."""
    marked = F.upper(sign).rlike("M[12]$")
    return F.struct(
        F.when(marked, F.regexp_replace(sign, "(?i)M[12]$", "")).otherwise(sign).alias("base"),
        F.when(marked, F.upper(F.right(sign, F.lit(2)))).otherwise("M2").alias("segment"),
    )


def clean(value: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(value), F.lit(""))


def first_clean(*values: Column) -> Column:
    return F.coalesce(*(clean(v) for v in values))


def degrees_minutes(value: Column, degree_digits: int, minus: str) -> Column:
    """Degrees of a fixed-width coordinate: a letter, degree digits, minutes, seconds and hundredths."""
    text = F.trim(value)
    part = lambda at, n: F.substring(text, at, n).try_cast("int")
    m = 2 + degree_digits
    size = part(2, degree_digits) + part(m, 2) / F.lit(60.0) + (part(m + 2, 2) + part(m + 4, 2) / F.lit(100.0)) / F.lit(3600.0)
    signed = F.when(F.substring(text, 1, 1) == minus, -size).otherwise(size)
    return F.when(F.length(text) >= m + 5, signed)


def latitude(value: Column) -> Column:
    return degrees_minutes(value, 2, "S")


def longitude(value: Column) -> Column:
    return degrees_minutes(value, 3, "W")


def elevation_ft(value: Column) -> Column:
    """Digits and minus signs of the text as a whole number, or null."""
    return F.regexp_replace(value, "[^0-9-]", "").try_cast("int")


def altitude_ft(value: Column) -> Column:
    """FLnnn in hundreds of feet, else feet; blank is null and other text an error."""
    text = F.upper(clean(value))
    return F.when(text.startswith("FL"), F.substring(text, 3, 10).cast("double") * 100).otherwise(text.cast("double"))


def route_tokens(sequence: Column, runway: Column) -> Column:
    """Upper-case fixes of a `>` sequence without blanks and NAN, then the runway as RWnn if absent."""
    fixes = F.filter(F.transform(F.split(F.coalesce(sequence, F.lit("")), ">"), lambda t: F.upper(F.trim(t))), lambda t: (t != "") & (t != "NAN"))
    end = F.concat(F.lit("RW"), F.upper(F.trim(runway)))
    return F.when(F.coalesce(F.trim(runway), F.lit("")) == "", fixes).when(F.array_contains(fixes, end), fixes).otherwise(F.array_append(fixes, end))


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.trim(path), r"\s+"), lambda t: t != "")


COORDINATE = r"^(-?\d+(?:\.\d+)?)[,/](-?\d+(?:\.\d+)?)$"


def coordinate_token(token: Column, position: Column) -> Column:
    """struct(identifier, lat, lon) of a `lat,lon` or `lat/lon` token; null for any other."""
    found = lambda k: F.regexp_extract(token, COORDINATE, k).try_cast("double")
    return F.when(token.rlike(COORDINATE), F.struct(F.format_string("COORD%02d", position).alias("identifier"), found(1).alias("lat"), found(2).alias("lon")))


def sequence_number(value: Column) -> Column:
    return F.coalesce(F.trim(value).try_cast("int"), F.lit(0))


def iso_utc(epoch: Column) -> Column:
    """ISO text of epoch seconds; needs a session in UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_clock(epoch: Column, zone: str = "America/Chicago") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "HH:mm:ss")


def day_start(ts: Column) -> Column:
    return F.unix_timestamp(F.date_trunc("day", ts))


def utc_of(local: Column, zone: str) -> Column:
    """The instant of a time given as text: with an offset (or Z) as it says, without one as local time of zone. Null for anything else."""
    stated = F.try_to_timestamp(F.when(local.rlike(r"([+-]\d{2}:?\d{2}|[Zz])$"), local))
    plain = F.try_to_timestamp(F.when(~local.rlike(r"([+-]\d{2}:?\d{2}|[Zz])$"), local))
    return F.coalesce(stated, F.to_utc_timestamp(plain, zone))


def datetime_range(first: Column, last: Column, zone: str) -> Column:
    """struct(local_from, local_to, utc_from, utc_to) of a range; the local ones are wall clock times of zone. A range that ends before it begins is an error."""
    a, b = utc_of(first, zone), utc_of(last, zone)
    ordered = F.when(a > b, F.raise_error(F.lit("the range ends before it begins")).cast("timestamp")).otherwise(a)
    return F.struct(F.from_utc_timestamp(ordered, zone).alias("local_from"), F.from_utc_timestamp(b, zone).alias("local_to"), ordered.alias("utc_from"), b.alias("utc_to"))


def range_label(first_day: Column, last_day: Column, airport: Column) -> Column:
    """day or day_to_day, then the airport in lower case."""
    a, b = F.date_format(first_day, "yyyy-MM-dd"), F.date_format(last_day, "yyyy-MM-dd")
    return F.concat(F.when(a == b, a).otherwise(F.concat(a, F.lit("_to_"), b)), F.lit("_"), F.lower(airport))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def anchors(html: Column, for_tag: str = " ") -> Column:
    """array of struct(url, label) of a page's links; labels without tags (for_tag in their place), entities and runs of space."""
    pattern = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    plain = lambda t: F.trim(F.regexp_replace(entities(F.regexp_replace(t, "<[^>]*>", for_tag)), r"\s+", " "))
    urls, labels = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(urls, labels, lambda u, t: F.struct(u.alias("url"), plain(t).alias("label")))


# Named entities of markup.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
ENTITY = r"&(#x[0-9A-Fa-f]+|#\d+|[A-Za-z]+);"


def entities(text: Column) -> Column:
    """Named and numbered entities as characters, in one pass: what a decoded one spells is left alone.

    Unknown names and numbers beyond the last code point stay as they are.
    """

    def char(found: Column) -> Column:
        body = F.substring(found, 2, 1 << 30)
        name = F.left(body, F.length(body) - 1)
        hexadecimal = F.when(F.lower(F.left(name, F.lit(2))) == "#x", F.substring(name, 3, 1 << 30)).when(F.left(name, F.lit(1)) == "#", F.conv(F.substring(name, 2, 1 << 30), 10, 16))
        digits = F.ltrim(hexadecimal, F.lit("0"))
        point = F.conv(digits, 16, 10).cast("long")
        known = (F.length(digits) <= 6) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        spelled = F.when(known, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        for entity, value in NAMED.items():
            spelled = F.when(name == entity, value).otherwise(spelled)
        return F.coalesce(spelled, found)

    between = F.split(text, ENTITY)
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda b, e: F.concat(b, F.coalesce(char(e), F.lit("")))), "")


def quoted_printable(text: Column) -> Column:
    """Soft line breaks joined and each =XX decoded to its byte; the bytes are read as UTF-8, where they do not fit as U+FFFD."""
    joined = F.regexp_replace(text, "=\r?\n", "")
    parts = F.split(joined, "=(?=[0-9A-Fa-f]{2})")
    digits = F.transform(parts, lambda p, i: F.when(i == 0, F.hex(p)).otherwise(F.concat(F.left(p, F.lit(2)), F.hex(F.substring(p, 3, 1 << 30)))))
    return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))


def _needed(value: Column, strict: bool, what: str) -> Column:
    """value, where it is null an error if strict."""
    return F.coalesce(value, F.raise_error(F.lit(f"no {what}")).cast("string")) if strict else value


def html_part(mhtml: Column, strict: bool = False) -> Column:
    """The decoded body of the first text/html part of a multipart text; where there is none, null or, if strict, an error."""
    boundary = F.regexp_extract(mhtml, r'(?i)boundary="([^"]+)"', 1)
    parts = F.split(mhtml, F.concat(F.lit("\\Q--"), boundary, F.lit("\\E")))
    part = F.get(F.filter(parts, lambda p: p.rlike(r"(?i)Content-Type:\s*text/html")), F.lit(0))
    blank = F.when(F.instr(part, "\r\n\r\n") > 0, F.instr(part, "\r\n\r\n") + 4).when(F.instr(part, "\n\n") > 0, F.instr(part, "\n\n") + 2)
    return _needed(F.when(boundary != "", quoted_printable(F.substr(part, blank))), strict, "html part")


def section(html: Column, heading: str, end: str, strict: bool = False) -> Column:
    """From a heading up to the next end marker; where either is missing, null or, if strict, an error."""
    start = F.instr(html, heading)
    rest = F.substr(html, start)
    stop = F.instr(rest, end)
    return _needed(F.when((start > 0) & (stop > 0), F.left(rest, stop - 1)), strict, f"section {heading}")


def chart_name(label: Column) -> Column:
    """A label as a key: no commas, runs of space and underscores as one underscore."""
    bare = F.replace(entities(F.trim(label)), F.lit(","), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", "_"), "_+", "_")


def m_to_ft(value: Column) -> Column:
    return value / FOOT_M


def ft_to_m(value: Column) -> Column:
    return value * FOOT_M


def mps_to_kts(value: Column) -> Column:
    return value / KNOT_MPS


def kts_to_mps(value: Column) -> Column:
    return value * KNOT_MPS


def mps_to_fpm(value: Column) -> Column:
    return value / FPM_MPS


def fpm_to_mps(value: Column) -> Column:
    return value * FPM_MPS
