"""Header values: keys, labels, rendering and typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def patient_key(name: Column, patient_id: Column) -> Column:
    """File name of a header document: carets and blanks in the name become underscores."""
    safe = F.translate(F.coalesce(name, F.lit(UNKNOWN)), "^ ", "__")
    return F.concat(safe, F.lit("_"), F.coalesce(patient_id, F.lit(UNKNOWN)), F.lit(".json"))


def render_bytes(value: Column) -> Column:
    """Hex of the first 50 bytes, always followed by dots."""
    return F.concat(F.lower(F.hex(F.substring(value, 1, 50))), F.lit("..."))


def render_value(raw: Column, text: Column, error: Column) -> Column:
    """Bytes as hex, other values as text, failures as a marker carrying the reason."""
    return (
        F.when(error.isNotNull(), F.concat(F.lit("UNREADABLE ("), error, F.lit(")")))
        .when(raw.isNotNull(), render_bytes(raw))
        .otherwise(text)
    )


def tag_label(group: Column, element: Column, name: Column) -> Column:
    return F.format_string("(%04X,%04X) %s", group, element, name)


def as_date(value: Column) -> Column:
    """``yyyyMMdd`` text to a date, null when malformed."""
    return F.when(value.rlike("^[0-9]{8}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd")).cast("date"))


def as_day_micros(value: Column) -> Column:
    """``HH[mm[ss[.ffffff]]]`` text to microseconds since midnight, null when malformed."""
    part = lambda i: F.regexp_extract(value, r"^(\d\d)(?:(\d\d)(?:(\d\d)(?:\.(\d{1,6}))?)?)?$", i)
    number = lambda c: F.when(c == "", 0).otherwise(c.try_cast("bigint"))
    hour, minute, second = part(1).try_cast("bigint"), number(part(2)), number(part(3))
    micros = F.rpad(part(4), 6, "0").try_cast("bigint")
    total = ((hour * 60 + minute) * 60 + second) * 1_000_000 + F.coalesce(micros, F.lit(0))
    return F.when((hour < 24) & (minute < 60) & (second < 60), total)


def as_timestamp(value: Column) -> Column:
    """``yyyy[MM[dd[HH[mm[ss[.ffffff]]]]]][+hhmm]`` text to a timestamp without zone, null when malformed.

    What is left out is the first of its kind. With an offset the result is UTC, otherwise the time as written.
    """
    pattern = r"^(\d{4}(?:\d\d){0,5})(?:\.(\d{1,6}))?([+-]\d{4})?$"
    digits, fraction, offset = (F.regexp_extract(value, pattern, i) for i in (1, 2, 3))
    whole = F.concat(digits, F.lit("00000101000000").substr(F.length(digits) + 1, F.lit(14)))
    stamp = F.try_to_timestamp(
        F.concat(whole, F.lit("."), F.rpad(fraction, 6, "0")), F.lit("yyyyMMddHHmmss.SSSSSS")
    ).cast("timestamp_ntz")
    ahead = F.concat(offset.substr(1, 1), offset.substr(2, 2)).try_cast("int") * 60 + F.concat(
        offset.substr(1, 1), offset.substr(4, 2)
    ).try_cast("int")
    legal = (fraction == "") | (F.length(digits) == 14)
    return F.when(legal & (digits != ""), stamp - F.make_dt_interval(mins=F.coalesce(ahead, F.lit(0))))


def as_values(value: Column) -> Column:
    """A multi-value rendered as a bracketed list back to ``array<string>``.

    Items may be in either quote, or bare as numbers are.
    """
    inner = F.regexp_extract(value, r"(?s)^\[(.*)\]$", 1)
    item = r"""'([^']*)'|"([^"]*)"|([^,'"\s][^,]*)"""
    bare = F.regexp_extract_all(inner, F.lit(f"({item})"), 1)
    listed = F.transform(bare, lambda v: F.when(
        v.rlike(r"""(?s)^'.*'$|^".*"$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(F.rtrim(v)))
    return F.when(value.isNull() | (value == ""), F.array().cast("array<string>")).when(
        value.startswith("[") & value.endswith("]"), listed
    ).otherwise(F.array(value))


def as_integer(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("int"))


def as_double(value: Column) -> Column:
    """A decimal string, null when malformed."""
    return F.when(F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(value).try_cast("double"))
