"""Hot keys, null keys and the ways taken when a side is too large to broadcast."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphray.operators import crop, joins, runs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        data.append((key, i * 7 % 3001, rng.choice([None, rng.randint(0, 9)]), f"payload {i}"))
    return spark.createDataFrame(data, "k string, at int, v int, payload string").cache()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("name", ["last", "sum", "number", "next", "previous"])
def test_scans_equal_plain_windows(rows, name, wide):
    df = rows if wide else rows.drop("payload")
    bucket, keys, order = runs.block("at", 50), ["k"], ["at"]
    w = Window.partitionBy("k").orderBy("at")
    v, so_far = F.col("v"), w.rowsBetween(Window.unboundedPreceding, 0)
    got, want = {
        "last": (lambda: runs.last_known(df, keys, order, bucket, "v", "o"), F.last("v", ignorenulls=True).over(so_far)),
        "sum": (lambda: runs.running_sum(df, keys, order, bucket, v, ["v"], "o"), F.coalesce(F.sum("v").over(so_far), F.lit(0))),
        "number": (lambda: runs.numbered(df, keys, order, bucket, "o"), F.row_number().over(w)),
        "next": (lambda: runs.next_value(df, keys, order, bucket, v, ["v"], "o"), F.lead("v").over(w)),
        "previous": (lambda: runs.previous_value(df, keys, order, bucket, v, ["v"], "o"), F.lag("v").over(w)),
    }[name]
    left = got().select(*df.columns, F.col("o").cast("bigint").alias("o"))
    right = df.withColumn("o", want.cast("bigint"))
    assert left.count() == right.count() == 3000
    assert left.exceptAll(right).count() == 0


def test_narrow_scan_reads_its_input_once(spark, rows, tmp_path):
    rows.drop("payload").write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    plan = runs.running_sum(stored, ["k"], ["at"], runs.block("at", 50), F.col("v"), ["v"], "o")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text


def _pixels(spark):
    return spark.range(2).select(F.col("id").alias("image_id")).crossJoin(
        spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"))
    ).withColumns({"height": F.lit(10), "width": F.lit(10), "p": F.lit(1)})


def test_range_join_without_broadcast(spark):
    rois = spark.createDataFrame(
        [("a", 2, 3, 7, 9), ("b", -5, -5, 3, 3), ("c", 0, 0, 2**30, 2**30), ("far", 50, 50, 60, 60)],
        "label string, x1 int, y1 int, x2 int, y2 int",
    )
    small = crop.pixels_in_rois(_pixels(spark), rois.filter("label <> 'c'"), tile=4)
    salted = crop.pixels_in_rois(_pixels(spark), rois.filter("label <> 'c'").hint("merge"), tile=4)
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.select(*small.columns).collect()))
    assert small.groupBy("label").count().orderBy("label").collect()[0]["count"] == 2 * 5 * 6
    whole = crop.pixels_in_rois(_pixels(spark), rois.filter("label = 'c'"))
    assert whole.count() == 200


def test_long_images_keep_all_pixels(spark):
    pixels = spark.createDataFrame([(1, 0, 100), (1, 0, 70_000), (1, 0, 250_000)], "image_id int, y int, x int")
    roi = spark.createDataFrame([("a", 0, 0, 200_000, 1)], "label string, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r["x"] for r in crop.pixels_in_rois(pixels, roi).collect()) == [100, 70_000]


def test_pairing_by_configuration(spark):
    images = spark.createDataFrame([(i, "hot" if i % 10 else "cold") for i in range(50)], "image_id int, config string")
    rois = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "config string, ord int")
    got = crop.pair_with_rois(images, rois.hint("merge"), ["config"])
    assert got.count() == 45 * 2 + 5


def test_pairing_without_broadcast(spark):
    images = spark.range(50).withColumnRenamed("id", "image_id")
    rois = spark.range(7).withColumnRenamed("id", "ord")
    a = crop.pair_with_rois(images, rois)
    b = crop.pair_with_rois(images, rois.hint("merge"))
    assert a.count() == b.count() == 350
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_stream_names_that_contain_each_other(spark):
    streams = spark.createDataFrame([("a",), ("ab",), ("abc",), ("zz",), ("Running",)], "stream string")
    containers = spark.createDataFrame([("ab: Up",), ("xaby: Up",)], "container string")
    loose = {r["stream"]: r["status"] for r in joins.stream_status(streams, containers).collect()}
    assert loose == {"a": "Running", "ab": "Running", "abc": "Stopped", "zz": "Stopped", "Running": "Stopped"}
    exact = {r["stream"]: r["status"] for r in joins.stream_status(streams, containers, exact=True).collect()}
    assert exact["ab"] == "Running" and exact["a"] == "Stopped"
    none = joins.stream_status(streams, containers.limit(0))
    assert none.filter("status = 'Stopped'").count() == 5


def test_missing_pids_do_not_match(spark):
    nodes = spark.createDataFrame([("n1", "stopped", None), ("n2", "stopped", 5), ("n3", "running", 6), ("n4", "stopped", 7)],
                                  "label string, status string, pid int")
    live = spark.createDataFrame([(5,), (5,), (6,), (None,)], "pid int")
    alive = {r["label"]: r["alive"] for r in joins.node_liveness(nodes, live).collect()}
    assert alive == {"n1": False, "n2": True, "n3": True, "n4": False}
    assert sorted(r["label"] for r in joins.startable_nodes(nodes, live).collect()) == ["n1", "n4"]


def _instances(spark):
    rng = random.Random(9)
    uid = lambda: rng.choice(["hot", "hot", "a", "b", "c", None])
    number, label = lambda: rng.choice([1, 2, None]), lambda: rng.choice(["r1", "r2", None])
    headers = spark.createDataFrame([(uid(), f"h{i}") for i in range(6)], "uid string, modality string")
    slices = spark.createDataFrame([(f"s{i}", uid(), number()) for i in range(12)], "shape string, uid string, slice_no int")
    crops = spark.createDataFrame([(uid(), number(), label(), i) for i in range(40)], "uid string, slice_no int, label string, pieces long")
    texts = spark.createDataFrame([(uid(), number(), label(), f"t{i}") for i in range(40)], "uid string, slice_no int, label string, text string")
    return headers, slices, crops, texts


def test_lineage_equals_joins_in_plain_order(spark):
    headers, slices, crops, texts = _instances(spark)
    cut, region = ["uid", "slice_no"], ["uid", "slice_no", "label"]
    want = headers.join(slices, "uid").join(crops, cut).join(texts, region, "left")
    got = joins.join_lineage(headers, slices, crops, texts)
    assert got.columns == want.columns
    key = lambda row: tuple(str(v) for v in row)
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == sorted(map(tuple, want.collect()), key=key) and len(rows) > 30


def test_lineage_moves_rows_once_for_each_key(spark):
    headers, slices, crops, texts = _instances(spark)
    cut, region = ["uid", "slice_no"], ["uid", "slice_no", "label"]
    inputs = headers, slices.select(*cut).distinct(), crops.groupBy(region).count(), texts.select(*region).distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.join_lineage(*inputs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 5, plan
