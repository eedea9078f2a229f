"""Rules of queries on tables that the smallest scale does not hold."""

import re
import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphray.operators import crop
from glyphray.sources import dicom, ini, logs, sinks
from tests.oracle import compare


def test_first_concept_with_large_part_keys(spark, tmp_path):
    rows = [(1, 1, 20_000, 7), (1, 2, 1, 7), (2, 3, 5, 999), (2, 3, 5, 1), (2, 3, 6, 0)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = entry.queries()["first_concept"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, "1:20000"), (2, "3:5")}
    assert compare(found, con, entry.oracle_sql()["first_concept"]) == []


def test_entries_and_their_continuations_share_a_file(spark, tmp_path):
    lines = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("n")).withColumn(
        "line", F.when(F.col("n") == 0, F.format_string("[2025-01-01 00:00:%02d] entry", "id")).otherwise("more"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_lines(lines, str(tmp_path / "o"), ["id"], within=["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert len(list((tmp_path / "o").glob("part-*"))) > 1
    found = logs.attach_continuations(logs.parse_logs(logs.read_log_lines(spark, str(tmp_path / "o"))))
    assert {r["n"] for r in found.groupBy("entry_ts").agg(F.count(F.lit(1)).alias("n")).collect()} == {21}


def test_single_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(200).coalesce(1).select(
        F.concat(F.lit("a="), F.col("id") % 2, F.lit("/"), "id", F.lit(".dcm")).alias("name"),
        F.when(F.col("id") > 0, F.encode(F.concat(F.lit("é\n\0"), "id"), "UTF-8")).alias("content"))
    for _ in range(2):  # a repetition writes the same files
        assert sinks.write_files(rows, f"file://{tmp_path}/o") == 200
    found = {str(p.relative_to(tmp_path / "o")): p.read_bytes() for p in (tmp_path / "o").rglob("*") if p.is_file()}
    assert found == {f"a={i % 2}/{i}.dcm": f"é\n\0{i}".encode() if i else b"" for i in range(200)}
    assert sinks.write_files(rows.limit(0), f"{tmp_path}/none") == 0


def test_large_configuration_files(spark):
    """Twenty times as many lines took four hundred times as long."""
    many = "\n".join(["  [late]", " a = 1", "  more", "[big]"] + [f"Key{i} = {i}" for i in range(60_000)] + ["  tail", "[end]", " odd", "last"])
    texts = spark.createDataFrame([("one", many), ("two", "# only\n[empty]\n"), ("none", None)], "source string, content string")
    start = time.time()
    rows = {r["ord"]: r for r in ini.read_ini(texts).collect()}
    assert time.time() - start < 60 and len(rows) == 60_002
    assert tuple(rows[0]) == ("one", 0, "late", "a", "1\nmore") and tuple(rows[1]) == ("one", 1, "big", "key0", "0")
    assert rows[60_000]["value"] == "59999\ntail\nodd" and tuple(rows[60_001])[2:] == ("end", None, "last")


def test_figures_of_regions_that_share_boxes(spark, monkeypatch):
    pixels = spark.range(3).select("id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select(
        "id", (F.col("i") / 4).cast("int").alias("y"), (F.col("i") % 4).alias("x"), F.col("i").alias("p"))
    boxes = [(f"r{i % 7}", i % 3, i % 2, i % 3 + 2, i % 2 + 2) for i in range(40)]
    rois = spark.createDataFrame(boxes, "roi string, x1 int, y1 int, x2 int, y2 int")
    inside = crop.pixels_in_rois(pixels, rois, tile=2).groupBy("id", "roi").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))
    wanted = sorted(tuple(r) for r in inside.collect())
    assert len(wanted) == 21
    for small in (crop.SMALL, 500):  # in one piece, in several
        monkeypatch.setattr(crop, "SMALL", small)
        found = crop.roi_figures(pixels, rois, "id", "roi", "p", tile=2)
        assert sorted(tuple(r) for r in found.collect()) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "roi" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line).split("]")[0]


def test_names_with_equal_boxes_are_added_up_once(spark, monkeypatch):
    pixels = spark.range(6).select("id", (F.col("id") % 2).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select(
        "id", "k", (F.col("i") / 4).cast("int").alias("y"), (F.col("i") % 4).alias("x"), F.col("i").alias("p"))
    # names in both configurations, twice the same box, no name, no configuration
    boxes = [(f"r{i}", k, 0, 0, 2, 2) for i in range(300) for k in (0, 1)]
    boxes += [("twice", 0, 1, 1, 3, 3)] * 2 + [(None, 1, 1, 1, 3, 3), ("once", 0, 1, 1, 3, 3), ("none", None, 0, 0, 2, 2), ("half", 1, None, 0, 2, 2)]
    rois = spark.createDataFrame(boxes, "roi string, k bigint, x1 int, y1 int, x2 int, y2 int")
    inside = crop.pixels_in_rois(pixels, rois, ["k"], tile=2).groupBy("id", "roi").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))
    wanted = sorted(map(repr, inside.collect()))
    assert len(wanted) == 6 * 300 + 3 * 3
    for small in (crop.SMALL, 5000):
        monkeypatch.setattr(crop, "SMALL", small)
        found = crop.roi_figures(pixels, rois, "id", "roi", "p", ["k"], tile=2)
        assert sorted(map(repr, found.collect())) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    sums = re.findall(r"keys=\[id#\d+L?, (\w+)#[^\]]*\], functions=\[sum", plan)
    assert sums and set(sums) == {"__shape"}  # nothing is grouped by image and name


def test_only_sequences_and_their_items_are_nested():
    row = lambda at, path, order, label, value, items: dict(
        at=at, item_path=path, ord=order, label=label, value=value, items=items)
    first = [row(4, [], 4, "S", None, 1), row(5, [4, 0], 0, "A", "x", None), row(6, [4, 0], 1, "T", None, 0)]
    files = pa.array([[row(9, [], 0, "U", None, 0)], None, first, None])
    patient = '"PatientName": "UNKNOWN", "PatientID": "UNKNOWN"'
    wanted = [[None] * 4 + ['[{%s, "A": "x", "T": []}]' % patient, None, "[]"], None]
    assert dicom._nest(files.slice(2)).to_pylist() == wanted
    assert dicom._nest(files).to_pylist() == [[None] * 9 + ["[]"], None, *wanted]
