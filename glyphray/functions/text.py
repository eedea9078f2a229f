"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the report writer treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` handles blanks only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.length(strip(col)) == 0


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def to_int(col: Column) -> Column:
    """Integer text with optional sign, padding and digit separators; anything else is null."""
    body = strip(col)
    return F.when(col.rlike(r"^[+-]?[0-9]+$"), col.try_cast("int")).when(
        body.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(body, F.lit("_"), F.lit("")).try_cast("int")
    )
