"""A persistent index of text digests, bucketed and sorted by hash; new data is anti-joined with it and appended."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphray.llm.store import shared_folder, shuffle_partitions, stored


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased and nothing else changed; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered, 256))


class DigestIndex:
    """Digests seen so far with the id that stays for each: a table bucketed and sorted by digest at ``path``.

    A later session opens the same path again, with the same number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (``doc_id``, ``digest``) that the index lacks, each with its largest id.

        Copies inside the batch are combined and written before they meet the index, or the optimizer would shuffle every
        copy to the join. The join is a sort-merge anti-join on the index's own buckets; the survivors are written back
        in the same buckets.
        """
        new = stored(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digests-batch")
        fresh = new.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        # the new rows are written aside first: a table can't be read and appended to in one step
        (
            stored(fresh, "digests-new").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
            .format("parquet").option("path", self.path).saveAsTable(self.name)
        )

    def drop(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``digest`` of every row."""
    return docs.select("doc_id", digest(F.col("text")).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text: ``digest``, ``keep_id`` (largest id), ``group_size``.

    The rows enter a fresh index in two batches, those with the larger ids first, so that what is already in the index
    is what stays. Rows without an id come last; a text that has no other rows has a null ``keep_id``.
    """
    spark = rows.sparkSession
    index = DigestIndex(spark, shared_folder(spark, "digest-index"), shuffle_partitions(spark))
    middle = rows.agg(F.percentile_approx("doc_id", 0.5, 1000).alias("middle"))
    halved = rows.crossJoin(F.broadcast(middle)).withColumn("late", F.coalesce(F.col("doc_id") > F.col("middle"), F.lit(False)))
    index.add(halved.filter("late"))
    index.add(halved.filter("not late"))
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    return stored(index.table().join(counted, "digest"), "digest-groups")


def membership(docs: DataFrame) -> DataFrame:
    """Every row's group: ``doc_id, digest, keep_id, group_size, kept``.

    Of equal texts the row with the largest ``doc_id`` stays. Of rows that are equal in id and text, one stays; of
    texts whose rows all lack an id, one row stays. Rows are counted by id and text before they are joined with their
    groups, and the join's two sides are plain exchanges that skew handling can split.
    """
    rows = stored(digests(docs), "digest-rows")
    found = groups(rows)
    runs = stored(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "digest-runs")
    return (
        runs.join(found, "digest")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
        .select("doc_id", "digest", "keep_id", "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"))
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each distinct text, all columns as they were."""
    key = lambda mark, doc_id: F.struct(mark.alias("mark"), doc_id.alias("doc_id")).alias("__key")
    keep = groups(stored(digests(docs), "digest-rows")).select(key(F.col("digest"), F.col("keep_id")))
    marked = docs.select("*", key(digest(F.col("text")), F.col("doc_id")))
    return marked.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
