"""What fails is told: modules, regions, pairs of hot configurations."""

import numpy as np
from pyspark.sql import functions as F

from glyphray.operators import chain, crop, packed
from glyphray.operators.chain import Module
from glyphray.plans.images import crop_failures, crop_images, crop_results


def images(spark, n=4, kind=3):
    rows = [(i, f"in/i{i}.png", i % 2, {"height": 2, "width": 2, "channels": kind, "data": bytes([i + 1] * 4 * kind)}) for i in range(n)]
    return spark.createDataFrame(rows, f"image_id long, image_name string, config long, image {packed.IMAGE}")


def boom(a):
    if (a == 2).any():
        raise ZeroDivisionError("no such luck")
    return np.full_like(a, 9)


def test_a_failing_module_stops_its_chain_and_says_why(spark):
    failing = Module("failing", lambda im: packed.threshold(packed.lift(boom)(packed.to_gray(im))))
    modules = [Module("flip", lambda im: packed.flip_channels(im)), failing, Module("after", lambda im: packed.threshold(im))]
    got = {r.image_id: r for r in chain.apply_chain(images(spark), modules).collect()}
    assert got[1].used == ["flip"] and got[1].error == "no such luck" and got[1].image["data"] == bytearray([2] * 12)
    for i in (0, 2, 3):
        assert got[i].used == ["flip", "failing", "after"] and got[i].error is None and got[i].image["channels"] == 1


def test_a_module_that_chooses_no_image_is_no_failure(spark):
    none = Module("none", lambda im: F.when(F.lit(False), im))
    got = chain.apply_chain(images(spark, 2), [none, Module("t", lambda im: packed.threshold(packed.to_gray(im)))]).collect()
    assert all(r.used == ["none", "t"] and r.error is None and r.image is not None for r in got)


def test_regions_that_cannot_be_cut_are_rows(spark):
    rois = spark.createDataFrame(
        [(0, "a", 0, 0, 1, 1), (0, "b", 1, 0, 0, 1), (1, "c", 0, 0, 0, 2)], "config long, label string, x1 int, y1 int, x2 int, y2 int")
    done = crop_results(images(spark), rois, ["config"])
    assert done.count() == 6
    assert sorted((r.image_path, r.error) for r in crop_failures(images(spark), rois, ["config"]).collect()) == [
        ("i0_b.jpg", "right before left"), ("i1_c.jpg", "empty box"), ("i2_b.jpg", "right before left"), ("i3_c.jpg", "empty box")]
    assert crop_images(images(spark), rois, ["config"]).count() == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_region_tables_split_hot_configurations_and_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2900, 0).otherwise(F.col("id") % 7).cast("int").alias("config"))
    rois = spark.range(70).select((F.col("id") % 8).cast("int").alias("config"), F.concat(F.lit("r"), "id").alias("label"))
    want = sorted(map(tuple, rows.join(rois, "config").select("id", "label").collect()))
    for small, kind in ((crop.SMALL, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        monkeypatch.setattr(crop, "SMALL", small)
        pairs = crop.pair_with_rois(rows, rois, ["config"])
        assert sorted(map(tuple, pairs.select("id", "label").collect())) == want and pairs.columns.count("config") == 1
        assert kind in plan(pairs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = crop.pair_with_rois(rows, rois, ["config"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in spread) < 0.6 * len(want)
    every = crop.pair_with_rois(rows, rois.drop("config"))
    assert every.count() == 3000 * 70 and "Broadcast" not in plan(every)
