"""Log lines in the five layouts the pipeline and its nodes write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout name -> pattern. Lines that match none continue the previous entry.
LAYOUTS = {
    "bracket": r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] (.*)$",
    "local": r"^\[[A-Z][a-z]{2} ([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d [AP]M) ([A-Z]{3,4}) (\d{4})\] (.*)$",
    "zoned": r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) ([A-Z]{3,4}) (\d{4}) - (.*)$",
    "micros": r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}) - (.*)$",
    "level": r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \[([A-Z]+)\] (.*)$",
}
# Zone abbreviations of log writers -> minutes ahead of UTC.
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "PKT": 300, "WIB": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "ART": -180, "NST": -210, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}


def _stamp(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def _to_utc(stamp: Column, zone: Column) -> Column:
    return stamp - F.make_dt_interval(mins=_zones()[zone])


def _zones() -> Column:
    return F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])


def layout(line: Column) -> Column:
    """Name of the layout, ``cont`` for a continuation."""
    fmt = F.lit("cont")
    for name in reversed(LAYOUTS):
        fmt = F.when(line.rlike(LAYOUTS[name]), name).otherwise(fmt)
    return fmt


def entry(line: Column, fmt: Column) -> Column:
    """``struct<ts, level, message, reason>`` of a line whose layout is known; ``ts`` is UTC.

    ``reason`` says why an entry has no time: an unknown zone or a date that does not exist.
    """
    get = lambda name, i: F.regexp_extract(line, LAYOUTS[name], i)
    one_blank = lambda c: F.regexp_replace(c, " +", " ")
    local = _stamp(F.concat_ws(" ", one_blank(get("local", 1)), get("local", 3)), "MMM d hh:mm:ss a yyyy")
    zoned = _stamp(F.concat_ws(" ", one_blank(get("zoned", 1)), get("zoned", 3)), "MMM d HH:mm:ss yyyy")
    ts = (
        F.when(fmt == "bracket", _stamp(get("bracket", 1), "yyyy-MM-dd HH:mm:ss"))
        .when(fmt == "local", _to_utc(local, get("local", 2)))
        .when(fmt == "zoned", _to_utc(zoned, get("zoned", 2)))
        .when(fmt == "micros", _stamp(get("micros", 1), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(fmt == "level", _stamp(get("level", 1), "yyyy-MM-dd HH:mm:ss,SSS"))
    )
    message = line
    for name, group in (("bracket", 2), ("local", 4), ("zoned", 4), ("micros", 2), ("level", 3)):
        message = F.when(fmt == name, get(name, group)).otherwise(message)
    level = F.when(fmt == "level", get("level", 2))
    zone = F.when(fmt == "local", get("local", 2)).when(fmt == "zoned", get("zoned", 2))
    reason = F.when(zone.isNotNull() & _zones()[zone].isNull(), F.concat(F.lit("unknown zone "), zone)).when(
        (fmt != "cont") & ts.isNull(), "no such time"
    )
    return F.struct(ts.alias("ts"), level.alias("level"), message.alias("message"), reason.alias("reason"))
