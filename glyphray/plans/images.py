"""Image flow: files -> slices -> crops -> module chain -> recognised lines -> report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphray.functions.names import crop_name, slice_name
from glyphray.operators import chain, crop, packed, reports
from glyphray.session import work_folder
from glyphray.sources import dicom, files, sinks


def slice_files(scanned: DataFrame, out: str, failures: str | None = None) -> None:
    """Slices of every readable file, named by instance and number.

    With ``failures``, a table of the files that gave none goes there, from the same pass.
    """
    cut = dicom.read_slices(files.filter_magic(scanned))
    if failures is not None:
        spark, parsed = scanned.sparkSession, work_folder(scanned.sparkSession, "slices")
        cut.write.parquet(parsed)
        cut = spark.read.parquet(parsed)
        cut.filter("error is not null").select("file_id", "error").write.mode("overwrite").json(failures)
    sinks.write_slices(cut.filter("error is null"), out)


def crop_images(images: DataFrame, rois: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``image_path, image`` with every region cut out, named after image and label.

    Regions are cut in the JVM while image and region meet, so full images go no further. With
    ``keys`` (a configuration name) each image meets only its own configuration. Regions that can't be cut
    are left out; ``crop_failures`` tells them.
    """
    return crop_results(images, rois, keys).filter("error is null").drop("error")


def crop_results(images: DataFrame, rois: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``image_path, image, error`` of every image and region that belong together: a crop, or why there is none."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    judged = rois.select(*keys, "label", "x1", "y1", "x2", "y2", crop.box_error(*box).alias("error"))
    return crop.pair_with_rois(images, judged, keys).select(
        crop_name(F.col("image_name"), F.col("label")).alias("image_path"),
        F.when(F.col("error").isNull(), packed.crop(F.col("image"), *box)).alias("image"), "error",
    )


def crop_failures(images: DataFrame, rois: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``image_path, error`` where a region of an image's configuration can't be cut; no pixels are read."""
    return crop_results(images, rois, keys).filter("error is not null").select("image_path", "error")


def read_text(crops: DataFrame, modules: Sequence[chain.Module], make_reader: Callable[[], Callable]) -> DataFrame:
    """``image_path, used, lines, ocr_error`` for cropped images: module chain, then recogniser."""
    done = chain.processed_or_original(crops, modules)
    return chain.recognize(done, make_reader).select("image_path", "used", "lines", "ocr_error")


def report(read: DataFrame) -> DataFrame:
    """Report rows straight from each recognised image, so the recogniser runs once."""
    return reports.report_rows(read, F.col("lines"))


def named_slices(slices: DataFrame) -> DataFrame:
    return slices.select(slice_name(F.col("sop_uid"), F.col("slice_no")).alias("image_name"), "image")
