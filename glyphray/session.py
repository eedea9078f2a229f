"""Session settings, the shared work folder, and helpers for expressions."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_work_root: str | None = None


def build_session(app: str = "glyphray", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; any of them can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may lack that setting; it gets a temporary folder. Anywhere else
    its absence is an error, since executors do not see each other's disks.
    """
    global _work_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _work_root is None:
            _work_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _work_root
    return f"{root.rstrip('/')}/glyphray-{uuid.uuid4().hex}/{name}"


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, wherever they were started."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "glyphray.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a scan over all cores: as they lie if no task reads more than twice its share, else dealt by ``keys``.

    Small tables come as one partition and are moved; large ones have enough pieces of their own, and moving them would take
    their size in disk. Counting rows by partition reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    # with a number, or small inputs end in one task
    return df if found.most * cores <= 2 * found.total else df.repartition(cores, *keys)


def with_fields(df: DataFrame, record: Column) -> DataFrame:
    """Append the fields of a struct expression, worked out once per row.

    Selecting fields of a computed struct lets the optimizer repeat the whole computation for every
    field; a one-element generator in between keeps it in one place.
    """
    return df.select("*", F.inline_outer(F.array(record)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def built_once(build: Callable[[], Column]) -> Callable[[], Column]:
    """Keep an expression that takes long to put together for as long as its Spark context lives."""
    kept: list = [None, None]

    @functools.wraps(build)
    def column() -> Column:
        context = SparkSession.active().sparkContext
        if kept[0] is not context:
            kept[:] = context, build()
        return kept[1]

    return column
