"""Files arriving in folders: trigger, hand-over, once-only processing, the header pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphray.functions.names import is_arrival
from glyphray.functions.text import base_name
from glyphray.operators.headers import latest_per_key
from glyphray.plans.headers import header_results
from glyphray.session import work_folder
from glyphray.sources import files, logs
from glyphray.streaming.keyed import KeyedTable

# Files of one batch; the driver holds the places and the tasks of all files of a batch at once.
FILES = 10_000
LOOK_UP = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
HEADERS = "patient_key string, path string, modificationTime timestamp, header map<string,string>"


def new_files(spark: SparkSession, folder: str, per_trigger: int | None = None, archive: str | None = None) -> DataFrame:
    """Stream of files created in one folder (not below it), all of them, ``per_trigger`` (``FILES`` by default) in a batch.
    With ``archive``, processed files are moved there once their batch is committed.

    The session then looks files up in four tasks a core at most: Spark's own setting makes a task of each file of a batch.
    """
    few = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LOOK_UP)) > few:
        spark.conf.set(LOOK_UP, few)
    reader = spark.readStream.format("binaryFile").schema(files.BINARY_FILE).option("maxFilesPerTrigger", per_trigger or FILES)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def arrivals(stream: DataFrame) -> DataFrame:
    """Only files that count as new image files."""
    return stream.filter(is_arrival(F.col("path")))


def hand_over(stream: DataFrame, folder: str = "Queue", path: str = "path", ts: str = "modificationTime") -> DataFrame:
    """Queue events for files taken over. The source's checkpoint makes each file count once."""
    return stream.select(
        base_name(F.col(path)).alias("file"), F.lit(folder).alias("folder"), F.lit("arrived").alias("event"),
        F.col(ts).alias("ts"),
    )


def once_only(stream: DataFrame, key: str = "path", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Each key once, however often it is announced within the watermark; state stays bounded."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def start_header_stream(
    stream: DataFrame, table: str, checkpoint: str, dictionary: DataFrame | None = None, failures: str | None = None
) -> StreamingQuery:
    """Arriving files to header documents, appended per batch to ``table``, and files that give none to ``failures``.

    Both are logs: a replayed batch overwrites its own partition, nothing else is rewritten.
    ``current_headers`` gives the latest document per patient. ``failures`` is ``table`` with ``_failures`` behind it by
    default.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        docs, failed = _parsed(batch, dictionary)
        _log(docs, table, batch_id)
        _log(failed, failures or f"{table.rstrip('/')}_failures", batch_id)

    return _start(stream, save, checkpoint)


def header_table(spark: SparkSession, path: str, **settings: int) -> KeyedTable:
    """The newest document per patient as a table with a bounded number of files."""
    schema = spark.createDataFrame([], HEADERS).schema
    return KeyedTable(spark, path, schema, ["patient_key"], ["modificationTime", "path"], **settings)


def start_header_table(
    stream: DataFrame, table: KeyedTable, failures: str, checkpoint: str, dictionary: DataFrame | None = None
) -> StreamingQuery:
    """Arriving files to ``table`` (see ``header_table``): a later file of a patient replaces an earlier one.

    Files that give no document go to the log ``failures`` (``path, error, batch``), from the same parse.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        docs, failed = _parsed(batch, dictionary)
        table.merge(docs, batch_id)
        _log(failed, failures, batch_id)

    return _start(stream, save, checkpoint)


def _parsed(batch: DataFrame, dictionary: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Documents and failures of a batch, parsed once."""
    out = work_folder(batch.sparkSession, "arrived")
    header_results(files.filter_magic(batch), dictionary).write.parquet(out)
    found = batch.sparkSession.read.parquet(out)
    return found.filter("error is null").drop("error"), found.filter("error is not null").select("path", "error")


def _log(rows: DataFrame, path: str, batch_id: int) -> None:
    (
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    )


def _start(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_headers(spark: SparkSession, table: str) -> DataFrame:
    return latest_per_key(spark.read.parquet(table).drop("batch"), ["patient_key"], ["modificationTime", "path"])


def log_tail(spark: SparkSession, folder: str, node: str) -> DataFrame:
    """Live log lines whose message comes from one selected node (``node: text``)."""
    lines = logs.parse_logs(spark.readStream.text(folder))
    return lines.filter(F.col("message").startswith(f"{node}: "))
