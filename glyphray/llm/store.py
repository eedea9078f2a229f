"""Tables written to the folder that all executors share, so that a lost executor loses no result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lets Spark remove the shuffle files of a write once the table is there to go on from.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: str | None = None
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine (``local[...]``) gets a temporary folder of its own; any
    other session must name a shared folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = f"file://{_local_root}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once and go on from the files: cuts lineage and gives the optimizer real sizes.

    Inside ``scratch`` the table lives as long as the scope, with ``keep`` as long as the scope around that.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``stored`` writes inside, at the end. What leaves the scope is written with ``keep``."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_limit(counts: DataFrame, column: str, most: int) -> int | None:
    """The least count such that at most ``most`` rows reach it, as steps allow; None if the highest step alone has more.

    Counts below 8192 are steps of their own, those above go by powers of two, so there are few steps at any size.
    """
    n = F.col(column)
    step = F.when(n < 8192, n).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long"))
    limit, room = None, most
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        room -= row["count"]
        if room < 0:
            break
        limit = row.step
    return limit
