"""Writers. Tables go through Spark's own committers, so a lost executor leaves no debris.

Single files (``write_files``) are written by the tasks under a hidden name and moved to their own: what a lost task leaves
is hidden, and its repetition writes the same files again.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.functions.names import crop_name, slice_name
from glyphray.functions.roi import render_roi
from glyphray.operators.headers import latest_per_key
from glyphray.operators.runs import block, numbered
from glyphray.sources.nodes import node_line
from glyphray.sources.ranges import located


def write_header_json(headers: DataFrame, path: str, buckets: int = 256) -> None:
    """One JSON document per patient key, the latest file winning; rewriting changes nothing.

    ``headers``: ``patient_key, modificationTime, path, header map<string,string>``. Keys are only
    hashed into folder names, so no name of a person shows in a path.
    """
    docs = latest_per_key(headers, ["patient_key"], ["modificationTime", "path"])
    (
        docs.withColumn("bucket", F.pmod(F.xxhash64("patient_key"), F.lit(buckets)))
        .select("bucket", "patient_key", "header")
        .hint("rebalance", F.col("bucket"))  # whole buckets per task where small, split where large
        .write.mode("overwrite").partitionBy("bucket").json(path)
    )


def write_files(files: DataFrame, path: str, name: str = "name", content: str = "content") -> int:
    """One file per row, ``name`` (may hold folders) below ``path``; null content gives an empty file. Returns their number.

    Names must differ: of equal ones any file stays. Rows are dealt by name into as many tasks as the cluster has cores, as
    small tables come as one partition. Spark's committers would move every file twice, the second time on the driver.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(path)
        made: set[str] = set()
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = posixpath.join(root, own)
                folder = posixpath.dirname(file)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                hidden = posixpath.join(folder, f".{uuid.uuid4().hex}")
                with store.open_output_stream(hidden) as out:
                    if data.is_valid:
                        out.write(data.as_buffer())
                store.move(hidden, file)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    dealt = files.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).repartition(
        files.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInArrow(write, "n bigint").agg(F.sum("n").alias("n")).first().n or 0


def write_slices(slices: DataFrame, path: str) -> None:
    """Packed slices with the name the image file would carry."""
    named = slices.withColumn("image_name", slice_name(F.col("sop_uid"), F.col("slice_no")))
    named.write.mode("overwrite").parquet(path)


def write_crops(crops: DataFrame, path: str, image_name: str = "image_name", label: str = "label") -> None:
    named = crops.withColumn("crop_name", crop_name(F.col(image_name), F.col(label)))
    named.write.mode("overwrite").parquet(path)


def write_crop_images(crops: DataFrame, path: str) -> None:
    """Crops that already carry their name (``image_path, image``); a region that left nothing has no file."""
    crops.filter("image is not null").write.mode("overwrite").parquet(path)


def append_report(lines: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append report lines. Without a run id a re-run repeats its blocks, as appending does;
    with one, a re-run of the same run replaces its own partition only."""
    if run_id is None:
        lines.write.mode("append").parquet(path)
        return
    (
        lines.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(path)
    )


def roi_lines(rois: DataFrame, config: str = "config", order: str = "ord", per_block: int = 100_000) -> DataFrame:
    """``roi_{i} = label:x1,y1,x2,y2`` with i from 1 in list order, per configuration."""
    with_no = numbered(rois, [config], [order], block(order, per_block), "roi_no")
    value = render_roi(*[F.col(c) for c in ("label", "x1", "y1", "x2", "y2")])
    return with_no.select(
        config, "roi_no", F.concat(F.lit("roi_"), F.col("roi_no"), F.lit(" = "), value).alias("line")
    )


# What a new configuration file contains before its regions.
DEFAULT_CONFIG = [
    "[paths]",
    "image_folder = jpg_out",
    "output_file = report_out",
    "modules_folder = modules",
    "preread_folder = preread_image",
    "temp_folder = temp",
    "",
    "[ocr]",
    "language = en",
    "generate_image = false",
    "",
    "[modules]",
    "enabled = delete_results, select_region, adaptive_threshold, preread_image_display",
    "",
]


def default_config_lines(configs: DataFrame, rois: DataFrame, config: str = "config") -> DataFrame:
    """Lines of a new file per configuration; the region section only where regions exist."""
    fixed = configs.select(config, F.posexplode(F.array(*[F.lit(s) for s in DEFAULT_CONFIG])).alias("line_no", "line"))
    base = len(DEFAULT_CONFIG)
    numbered_rois = roi_lines(rois, config)
    heads = rois.select(config).distinct().select(config, F.lit(base).alias("line_no"), F.lit("[ROI]").alias("line"))
    body = numbered_rois.select(config, (F.col("roi_no") + base).cast("int").alias("line_no"), "line")
    return fixed.unionByName(heads).unionByName(body)


def write_config_files(lines: DataFrame, path: str, config: str = "config", order: str = "line_no") -> None:
    """One file per configuration, in a folder of its name; a configuration file is small by nature."""
    (
        lines.select(config, order, "line").repartition(config).sortWithinPartitions(config, order)
        .select(config, F.col("line").alias("value")).write.mode("overwrite").partitionBy(config).text(path)
    )


def registry_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select(node_line(*[F.col(c) for c in ("label", "path", "status", "pid")]).alias("value"))


def write_lines(
    lines: DataFrame, path: str, order: list[str | Column], line: str = "line", within: Sequence[str | Column] = ()
) -> None:
    """Text output in order: range partitioning keeps files sorted among and within themselves.

    Lines that are equal in ``order`` share a file, sorted by ``within``: what must not be torn apart (an entry and the
    lines that continue it) goes there. Finding the ranges samples the input first; behind a recogniser, store the lines
    (``append_report``) and render them from there.
    """
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order, *within)
        .select(F.col(line).alias("value")).write.mode("overwrite").text(path)
    )
