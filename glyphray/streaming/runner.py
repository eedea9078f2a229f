"""Run a stream over what is there now and read the result back from shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphray.session import work_folder


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Process all available input, then return the written table.

    Append mode uses the file sink. Complete mode rewrites the result per batch; only the last
    batch's folder is read back, and without any batch the table is empty. Update mode has no
    single table to return and is refused.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode!r}: only append and complete give one table")
    out, checkpoint = work_folder(spark, name), work_folder(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    batches: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")
        batches.append(batch_id)

    writer.foreachBatch(save).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/{batches[-1]}")
