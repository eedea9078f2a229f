"""Modules in a row as one call, medians by counting, names inside texts, line numbers, headers with repeated labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import documents
from glyphray.operators import chain, joins, packed
from glyphray.operators.chain import Module
from glyphray.plans.headers import _document
from glyphray.sources import logs
from tests.test_failures import boom, images, plan


def rows(df):
    return [(r.image_id, r.used, r.error, r.image and (r.image["channels"], bytes(r.image["data"]))) for r in df.orderBy("image_id").collect()]


def apart(modules):
    """The same modules, none with a kernel, so each goes its own way."""
    return [Module(m.name, m.process, m.check, m.enabled, m.params) for m in modules]


def mixed(spark):
    """Colour, gray, null and damaged images."""
    colour, gray = images(spark, 4), images(spark, 3, 1).withColumn("image_id", F.col("image_id") + 10)
    image = F.col("image")
    cut = F.struct(image["height"].alias("height"), image["width"].alias("width"), image["channels"].alias("channels"), F.lit(b"x").alias("data"))
    broken = images(spark, 2).withColumn("image_id", F.col("image_id") + 20).withColumn("image", F.when(F.col("image_id") == 21, cut))
    return colour.union(gray).union(broken)


@pytest.mark.parametrize("names", [
    ["convert_black_white"], ["upscaling", "Medianblur"], ["select_region", "tuned_filter"], ["convert_black_white", "upscaling"],
    ["upscaling", "select_region", "select_region", "convert_black_white"], ["adaptive_threshold"],
])
def test_one_call_gives_what_single_modules_give(spark, names):
    modules = [chain.REGISTRY[n] for n in names]
    if names.count("select_region") == 2:
        modules[1] = modules[1].with_params(box=(0, 0, 2, 1))  # the second one has an empty box: no image
    assert rows(chain.apply_chain(mixed(spark), modules)) == rows(chain.apply_chain(mixed(spark), apart(modules)))


def test_modules_of_both_kinds_take_turns(spark):
    flip = Module("flip", lambda im: packed.flip_channels(im), chain._colour)
    modules = [chain.REGISTRY["select_region"], flip, chain.REGISTRY["upscaling"], chain.REGISTRY["convert_black_white"], flip]
    assert rows(chain.apply_chain(mixed(spark), modules)) == rows(chain.apply_chain(mixed(spark), apart(modules)))


def test_a_kernel_that_raises_stops_its_image_alone(spark):
    modules = [chain.from_kernel("failing", lambda a: boom(packed.gray_of(a))), chain.from_kernel("after", lambda a: packed.above(a, 1), False)]
    got = {r.image_id: r for r in chain.apply_chain(images(spark), modules).collect()}
    assert (got[1].used, got[1].error, bytes(got[1].image["data"])) == ([], "no such luck", bytes([2] * 12))
    assert all(got[i].used == ["failing", "after"] and got[i].error is None for i in (0, 2, 3))


def test_a_chain_of_kernels_is_one_python_call(spark):
    modules = [chain.REGISTRY[n] for n in ("select_region", "tuned_filter", "convert_black_white")]
    assert plan(chain.apply_chain(images(spark), modules)).count("ArrowEvalPython [") == 1
    # besides the chain only the bytes of the result go through Python
    assert plan(documents.chain_first_error_stops(spark, "/root/testdata/sf0.001")).count("ArrowEvalPython [") == 2


@pytest.mark.parametrize("k", [9, 11, 49])
@pytest.mark.parametrize("shape", [(3, 8, 8, 1), (2, 13, 7, 3), (1, 1, 1, 1), (1, 4, 30, 2)])
def test_counted_medians(monkeypatch, k, shape):
    monkeypatch.setattr(packed, "STRIP", 11)
    a = np.random.default_rng(k).integers(0, 256, shape, dtype=np.uint8)
    r = k // 2
    wide = np.pad(a, ((0, 0), (r, r), (r, r), (0, 0)), mode="edge")
    want = [[np.median(wide[:, y : y + k, x : x + k], axis=(1, 2)) for x in range(shape[2])] for y in range(shape[1])]
    assert (packed.median_of(a, k) == np.array(want).transpose(2, 0, 1, 3)).all()


def test_names_inside_long_texts(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab-é"), n)) for n in (0, 1, 5, 60, 5000)] + [None, "svc-alpha: Up", "svc-alpha: Up"]
    names = sorted({t[i : i + n] for t in texts[:5] for i in (0, 2, 40) for n in (1, 3, 4, 17)} | {"", "alpha", "alphb", "svc-alpha: Up", "svc-alpha: Up "})
    got = joins.stream_status(
        spark.createDataFrame([(n,) for n in [*names, None, "alpha"]], "stream string"),
        spark.createDataFrame([(t,) for t in texts], "container string")).collect()
    assert len(got) == len(names) + 2
    for r in got:
        inside = bool(r.stream) and any(r.stream in t for t in texts if t)
        assert r.status == ("Running" if inside else "Stopped"), r.stream


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 700)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(n)))
    (tmp_path / "d.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "9000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = logs.read_log_lines(spark, str(tmp_path))
            assert found.count() == 3701
            assert found.filter(F.split("value", " ")[1].cast("long") != F.col("line_no")).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_of_many_tags_keep_the_last_of_a_label(spark):
    tag = F.struct(
        F.when(F.col("id") % 7 == 3, 1).otherwise(0).alias("depth"), F.concat(F.lit("(0011,"), F.col("id") % 4000, F.lit(")")).alias("tag"),
        F.lit("x").alias("name"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("value"), F.col("id"))
    tags = spark.range(6000).agg(F.sort_array(F.collect_list(F.struct("id", tag.alias("t"))))["t"].alias("tags"))
    got = [tuple(e) for e in tags.select(F.map_entries(_document(F.col("tags"))).alias("d")).first().d]
    want = {}
    for i in (i for i in range(6000) if i % 7 != 3):
        want.pop(f"(0011,{i % 4000}) x", None)
        want[f"(0011,{i % 4000}) x"] = str(i) if i % 5 else None
    assert got[:2] == [("PatientName", "UNKNOWN"), ("PatientID", "UNKNOWN")] and got[2:] == list(want.items())


def test_blur_holds_a_bounded_part_of_a_batch():
    import tracemalloc

    images = packed.to_arrow([np.full((8, 8, 1), i % 256, np.uint8) for i in range(40_000)])
    tracemalloc.start()
    seen = 0
    for at, stack in packed._stacks(images, 1):
        assert (packed.gaussian_of(stack, 15) == stack).all()
        seen += len(at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 40_000
    assert peak < 50e6, peak
