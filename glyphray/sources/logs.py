"""Log files as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphray.functions.logs import entry, layout
from glyphray.operators.runs import block, last_known
from glyphray.session import with_fields

LINES_PER_BLOCK = 100_000


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``fmt, ts, level, message, reason`` to lines of text, without a shuffle."""
    laid_out = with_fields(lines, F.struct(layout(F.col(value)).alias("fmt")))
    return with_fields(laid_out, entry(F.col(value), F.col("fmt"))).drop(value)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source, block, line_no, value``; ``line_no`` counts the lines of a file from 0, however it is split.

    Large files are read in splits. An id that grows within a task gives a line's place in its split, and one narrow
    pass counts the lines of each split, whose running sums are the numbers at which splits begin. No single task per file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("__id"),
        "value",
    )
    splits = raw.groupBy("source", "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.withColumn("__begin", F.coalesce(F.sum("__lines").over(earlier), F.lit(0))).drop("__lines")
    return raw.join(begins, ["source", "block"]).select(
        "source", "block", (F.col("__begin") + F.col("__id") - F.col("__first")).alias("line_no"), "value"
    )


def attach_continuations(logs: DataFrame, source: str = "source", lines: int = LINES_PER_BLOCK) -> DataFrame:
    """Continuation lines get the timestamp of the entry above them (``entry_ts``), null where that has none."""
    order = [c for c in ("block", "line_no") if c in logs.columns]
    bucket = F.struct(*order[:-1], block("line_no", lines).alias("part"))
    boxed = logs.withColumn("__entry", F.when(F.col("fmt") != "cont", F.struct("ts")))
    known = last_known(boxed, [source], order, bucket, "__entry", "__above")
    return known.withColumn("entry_ts", F.col("__above.ts")).drop("__entry", "__above")
