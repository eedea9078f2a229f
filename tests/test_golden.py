"""Fixed values for expressions and image operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphray.functions import header, names, roi
from glyphray.operators import chain, packed, pixels
from glyphray.functions.text import stem, strip, to_int


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def gray_table(spark, a):
    h, w = a.shape
    rows = [(0, h, w, y, x, int(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, height int, width int, y int, x int, p int")


def gray_packed(spark, a):
    h, w = a.shape
    row = (0, (h, w, 1, bytearray(a.astype(np.uint8).tobytes())))
    return spark.createDataFrame([row], f"image_id int, image {packed.IMAGE}")


def as_array(df):
    rows = df.collect()
    h, w = 1 + max(r["y"] for r in rows), 1 + max(r["x"] for r in rows)
    a = np.zeros((h, w), int)
    for r in rows:
        a[r["y"], r["x"]] = r["p"]
    assert len(rows) == h * w
    return a


IMAGE = np.random.default_rng(7).integers(0, 256, (5, 9))


@pytest.mark.parametrize("raw,box", [
    ("waarde1:632,1005,671,1023", ("waarde1", 632, 1005, 671, 1023)),
    (" a : 1 , -2 ,+3,4_0 ", ("a", 1, -2, 3, 40)),
    (":1,2,3,4", ("", 1, 2, 3, 4)),
])
def test_parse_roi_good(spark, raw, box):
    r = one(spark, roi.parse_roi(F.lit(raw)))
    assert (r["label"], r["x1"], r["y1"], r["x2"], r["y2"]) == box and r["reason"] is None


@pytest.mark.parametrize("raw,reason", [
    ("a:1,2,3", roi.WRONG_COUNT), ("a:1,2,3,4,5", roi.WRONG_COUNT), ("a:1,2,x", roi.NOT_PARSED), ("a", roi.NOT_PARSED),
    ("a:b:1,2,3,4", roi.NOT_PARSED), ("a:", roi.NOT_PARSED), ("a:1.5,2,3,4", roi.NOT_PARSED), (None, roi.NOT_PARSED),
])
def test_parse_roi_bad(spark, raw, reason):
    r = one(spark, roi.parse_roi(F.lit(raw).cast("string")))
    assert r["reason"] == reason and r["label"] is None and r["x1"] is None


def test_truncation_towards_zero(spark):
    box = roi.to_image(F.lit(-2.7), F.lit(1.9), F.lit(3.9), F.lit(-0.5), F.lit(1.0))
    assert tuple(one(spark, box)) == (-2, 0, 3, 1)


def test_empty_rectangle_is_null(spark):
    assert one(spark, roi.rect_xywh(F.lit(3), F.lit(1), F.lit(3), F.lit(9))) is None
    assert tuple(one(spark, roi.rect_xywh(F.lit(5), F.lit(1), F.lit(3), F.lit(9)))) == (3, 1, 2, 8)


def test_bytes_always_get_dots(spark):
    assert one(spark, header.render_bytes(F.lit(b"\x01\x02\x03"))) == "010203..."
    assert one(spark, header.render_bytes(F.lit(b"\xab" * 60))) == "ab" * 50 + "..."


def test_patient_key(spark):
    assert one(spark, header.patient_key(F.lit("A^B c"), F.lit("9"))) == "A_B_c_9.json"
    null = F.lit(None).cast("string")
    assert one(spark, header.patient_key(null, null)) == "UNKNOWN_UNKNOWN.json"


@pytest.mark.parametrize("name,want", [("a.b.jpg", "a.b"), (".hidden", ".hidden"), ("a..jpg", "a."), ("plain", "plain"), ("..x", "..x")])
def test_stem(spark, name, want):
    assert one(spark, stem(F.lit(name))) == want


@pytest.mark.parametrize("path,want", [
    ("/in/a.dcm", True), ("/in/a.DCM", False), ("/in.dir/noext", True), ("/in/SC.1.3", False), ("x.dcm.part", False),
])
def test_arrival(spark, path, want):
    assert one(spark, names.is_arrival(F.lit(path))) is want


@pytest.mark.parametrize("name,want", [
    ("1.2.3_slice_4.jpg", ("1.2.3", 4, None)),
    ("1.2.3_slice_4_waarde1.jpg", ("1.2.3", 4, "waarde1")),
    ("1.2.3_slice_12_a_b_ocr_results.txt", ("1.2.3", 12, "a_b")),
    ("1.2.3_slice_12_ocr_results.txt", ("1.2.3", 12, None)),
    ("other.txt", (None, None, None)),
])
def test_lineage(spark, name, want):
    assert tuple(one(spark, names.lineage(F.lit(name)))) == want


def test_strip_and_int(spark):
    assert one(spark, strip(F.lit(" \t x  \x1f"))) == "x"
    assert one(spark, to_int(F.lit(" +12 "))) == 12
    assert one(spark, to_int(F.lit("99999999999"))) is None


@pytest.mark.parametrize("value,kind,want", [
    ("20240229", "date", "2024-02-29"), ("20230229", "date", None), ("151313.648", "time", str(((15 * 60 + 13) * 60 + 13) * 10**6 + 648000)),
    ("246000", "time", None), ("1205", "time", str((12 * 60 + 5) * 60 * 10**6)), ("12", "time", str(12 * 3600 * 10**6)),
    ("2024", "timestamp", "2024-01-01 00:00:00"), ("202401011200", "timestamp", "2024-01-01 12:00:00"),
    ("20240101120000.25+0100", "timestamp", "2024-01-01 11:00:00.25"), ("20240101-0030", "timestamp", "2024-01-01 00:30:00"),
    ("20240101.5", "timestamp", None), ("2024013", "timestamp", None), ("20241301", "timestamp", None),
    ("[0.5, 0.25]", "values", "[0.5, 0.25]"), ("[\"O'Brien\", 'x']", "values", "[O'Brien, x]"), ("['a b', '']", "values", "[a b, ]"),
    ("plain", "values", "[plain]"), ("-1.5e2", "double", "-150.0"), ("1,5", "double", None), ("20240102030405.5", "timestamp", "2024-01-02 03:04:05.5"), ("7", "int", "7"), ("x", "int", None),
])
def test_typed_values(spark, value, kind, want):
    from glyphray.operators.headers import TYPES

    assert one(spark, TYPES[kind](F.lit(value)).cast("string")) == want


def test_cubic_weights_at_factor_two(spark):
    got = one(spark, F.array(*pixels._cubic_weights(F.lit(0.25))))
    assert got == [-27, 225, 67, -9]
    assert one(spark, F.array(*pixels._cubic_weights(F.lit(0.75)))) == [-9, 67, 225, -27]


def test_kernel_sizes():
    assert [pixels.odd_kernel(k) for k in (0, 4, 49)] == [1, 5, 49]
    for v in (1, 3, 15):
        w = pixels.gaussian_weights(v)
        assert len(w) == 2 * v + 1 and sum(w) == 65536 and w == w[::-1]


FORMS = {
    "adaptive": (lambda d: pixels.adaptive_threshold(d, 4, 3), lambda c: packed.adaptive_threshold(c, 4, 3)),
    "gaussian": (lambda d: pixels.gaussian_blur(d, 3), lambda c: packed.gaussian_blur(c, 3)),
    "median": (lambda d: pixels.median_blur(d, 4), lambda c: packed.median_blur(c, 4)),
    "double": (lambda d: pixels.upscale(d, 2), lambda c: packed.upscale(c, 2)),
    "half more": (lambda d: pixels.upscale(d, 1.5), lambda c: packed.upscale(c, 1.5)),
    "half": (lambda d: pixels.upscale(d, 0.5), lambda c: packed.upscale(c, 0.5)),
}
SHAPES = {"5x9": IMAGE, "1x9": IMAGE[:1], "5x1": IMAGE[:, :1], "1x1": IMAGE[:1, :1]}
# one line or column can't be halved
CASES = [(f, s) for f in FORMS for s in SHAPES if f != "half" or s == "5x9"]


@pytest.mark.parametrize("form,shape", CASES)
def test_both_forms_agree(spark, form, shape):
    (long_form, packed_form), a = FORMS[form], SHAPES[shape]
    wide = packed.unpack_gray(gray_packed(spark, a).withColumn("image", packed_form(F.col("image"))))
    assert (as_array(long_form(gray_table(spark, a))) == as_array(wide)).all()


def test_constant_image_keeps_its_mean(spark):
    flat = gray_table(spark, np.full((4, 6), 93))
    assert {r["mean"] for r in pixels.box_mean(flat, 2).collect()} == {93}
    assert set(as_array(pixels.gaussian_blur(flat, 2)).ravel()) == {93}


def test_threshold_is_strict_and_idempotent(spark):
    once = pixels.threshold(gray_table(spark, np.array([[127, 128]])), 127)
    assert as_array(once).tolist() == [[0, 255]]
    assert as_array(pixels.threshold(once)).tolist() == [[0, 255]]


def test_bands_equal_whole_image(spark):
    tall = np.random.default_rng(1).integers(0, 256, (23, 6))
    df = gray_packed(spark, tall)
    blur = lambda c: packed.gaussian_blur(packed.median_blur(c, 3), 2)
    whole = as_array(packed.unpack_gray(df.withColumn("image", blur(F.col("image")))))
    bands = packed.trim_bands(packed.split_bands(df, 4, 3).withColumn("image", blur(F.col("image"))))
    parts = packed.unpack_gray(bands).withColumn("y", F.col("y") + F.col("y0"))
    assert (as_array(parts) == whole).all()


def test_full_crop_is_identity(spark):
    df = gray_packed(spark, IMAGE)
    same = df.withColumn("image", packed.crop(F.col("image"), F.lit(0), F.lit(0), F.lit(9), F.lit(5)))
    assert (as_array(packed.unpack_gray(same)) == IMAGE).all()
    assert df.select(packed.crop(F.col("image"), F.lit(9), F.lit(0), F.lit(12), F.lit(5)).alias("i")).first()["i"] is None


def test_module_registry():
    found, dropped = chain.load_order(["delete_results", " select_region", "adaptive_threshold ", "upscaling"])
    assert [m.name for m in found] == ["select_region", "adaptive_threshold", "upscaling"]
    assert dropped == ["delete_results"]
    off = {**chain.REGISTRY, "upscaling": chain.Module("upscaling", None, enabled=False)}
    assert chain.load_order(["upscaling"], off) == ([], ["upscaling"])


def test_unreadable_image_in_chain(spark):
    df = gray_packed(spark, IMAGE).select("image_id", F.lit(None).cast(packed.IMAGE).alias("image"))
    row = chain.apply_chain(df, [chain.REGISTRY["convert_black_white"], chain.REGISTRY["upscaling"]]).first()
    assert row["image"] is None and row["used"] == [] and row["error"] == chain.UNREADABLE


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        pixels.threshold(gray_table(spark, IMAGE), 256)
    with pytest.raises(ValueError):
        pixels.pad_border(gray_table(spark, IMAGE), "x", 1, 1, "wrap")


def test_damaged_images_give_null(spark):
    rows = [(0, (2, 2, 1, bytearray(b"abc"))), (1, (None, 2, 1, bytearray(b"ab"))), (2, (1, 2, 1, None)), (3, None), (4, (1, 2, 1, bytearray(b"ab")))]
    df = spark.createDataFrame(rows, f"image_id int, image {packed.IMAGE}")
    got = {r["image_id"]: r["image"] for r in df.withColumn("image", packed.threshold(F.col("image"), 97)).collect()}
    assert [got[i] for i in range(4)] == [None] * 4
    assert bytes(got[4]["data"]) == b"\x00\xff"


def test_crops_meet_their_own_configuration(spark):
    from glyphray.plans.images import crop_images

    a = gray_packed(spark, IMAGE).select(F.lit("1.2_slice_1.jpg").alias("image_name"), "image")
    images = a.withColumn("config", F.lit("A")).unionByName(a.withColumn("config", F.lit("B")))
    rois = spark.createDataFrame([("A", "x", 0, 0, 2, 3), ("B", "y", 1, 1, 2, 2), ("B", "bad", 3, 3, 1, 4)],
                                 "config string, label string, x1 int, y1 int, x2 int, y2 int")
    got = {r["image_path"]: (r["image"]["height"], r["image"]["width"]) for r in crop_images(images, rois, ["config"]).collect()}
    assert got == {"1.2_slice_1_x.jpg": (3, 2), "1.2_slice_1_y.jpg": (1, 1)}
