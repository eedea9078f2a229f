"""INI configuration as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphray.functions.text import strip


def read_ini_text(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files as ``source, content``; a configuration file is small by nature."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))
    )


def read_ini(texts: DataFrame) -> DataFrame:
    """``source, content`` to ``source, ord, section, key, value``; ``source`` names one text.

    Keys are lower-cased, values trimmed, full-line comments dropped, and indented lines continue the value above, if there
    is one. The lines of a file become rows whose section and entry come from running scans, so cost grows with their number.
    """
    lines = F.filter(
        F.split("content", "\r?\n", -1),
        lambda s: ~((strip(s) == "") | strip(s).startswith("#") | strip(s).startswith(";")),
    )
    section = lambda s: F.regexp_extract(s, r"^\[([^\]]+)\]", 1)
    # up to the first line that is no section head there is no value to continue
    first = F.array_position(F.transform("lines", lambda s: section(strip(s)) == ""), F.lit(True)) - 1
    told = (
        texts.select("source", lines.alias("lines")).select("source", first.alias("first"), "lines")  # once per file
        .select("source", "first", F.posexplode("lines").alias("pos", "line"))
        .withColumns({"text": strip(F.col("line")), "more": F.col("line").rlike(r"^\s") & (F.col("pos") > F.col("first"))})
        .withColumn("head", F.when(~F.col("more"), F.nullif(section(F.col("text")), F.lit(""))))
        .withColumn("starts", F.col("head").isNull() & ~F.col("more"))
    )
    above = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = told.select(
        "source", "pos", "text", "head", "starts", F.last("head", ignorenulls=True).over(above).alias("section"),
        (F.sum(F.col("starts").cast("int")).over(above) - 1).cast("int").alias("ord"),
    ).filter("head is null")
    entry = r"^([^=:]*?)\s*[=:]\s*(.*)$"
    known = F.col("starts") & F.col("text").rlike(entry)
    key = F.when(known, F.lower(F.regexp_extract("text", entry, 1)))
    piece = F.when(known, F.regexp_extract("text", entry, 2)).otherwise(F.col("text"))
    pieces = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return placed.groupBy("source", "ord").agg(
        F.max(F.when(F.col("starts"), F.col("section"))).alias("section"), F.max(key).alias("key"), pieces.alias("pieces"),
    ).select("source", "ord", "section", "key", F.array_join("pieces.piece", "\n").alias("value"))
