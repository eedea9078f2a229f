"""Names of files and instances: lineage, arrival rule, image extensions, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphray.functions.text import base_name, stem
from glyphray.session import bind

LINEAGE = r"^(.+?)_slice_(\d+)(?:_(?!ocr_results(?:\.|$))(.+?))?(?:_ocr_results)?(?:\.[^._]+)?$"


def is_image_name(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(jpg|jpeg|png)$")


def is_arrival(path: Column) -> Column:
    """A new file counts when it ends in ``.dcm`` (exact case) or its name has no dot."""
    return path.endswith(".dcm") | ~F.contains(base_name(path), F.lit("."))


def slice_name(uid: Column, number: Column) -> Column:
    return F.concat(uid, F.lit("_slice_"), number.cast("string"), F.lit(".jpg"))


def crop_name(image: Column, label: Column) -> Column:
    return F.concat(stem(base_name(image)), F.lit("_"), label, F.lit(".jpg"))


def report_name(image: Column) -> Column:
    return F.concat(stem(base_name(image)), F.lit("_ocr_results.txt"))


def lineage(name: Column) -> Column:
    """Instance, slice number and optional region label read back from a file name."""
    return bind(lineage_parts(name), lineage_record)


def lineage_parts(name: Column) -> Column:
    """The three parts of a file name as texts; a name that does not fit stays in one piece. One match per name."""
    return F.split(F.regexp_replace(name, LINEAGE, "$1\u0001$2\u0001$3"), "\u0001", -1)


def lineage_record(parts: Column) -> Column:
    """``lineage`` from a column that holds the parts; it mentions them often, so they should be worked out before."""
    known = F.size(parts) == 3
    return F.struct(
        F.when(known, F.get(parts, F.lit(0))).alias("uid"),
        F.get(parts, F.lit(1)).try_cast("int").alias("slice_no"),
        F.nullif(F.get(parts, F.lit(2)), F.lit("")).alias("label"),
    )


def instance_uid(key: Column) -> Column:
    """A repeatable identifier under the UUID root, from 60 bits of the key's hash."""
    return F.concat(F.lit("2.25."), F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10))


def coding_scheme(code: Column) -> Column:
    return F.when(code == "74019-1", "LN").otherwise("DCM")
