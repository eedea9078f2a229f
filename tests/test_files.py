"""Synthetic files: headers in both encodings, broken ones, images, folders, text sources."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from checks import files as check_files
from glyphray.operators import chain, checks, packed
from glyphray.plans.headers import dump_headers, header_documents, header_failures
from glyphray.plans.images import crop_images, read_text, report
from glyphray.sources import dicom, files, ini, logs, nodes, sinks

PREAMBLE = b"\0" * 128 + b"DICM"


def element(tag, vr, value, explicit=True):
    value += (b"\0" if vr in ("UI", "OB") else b" ") * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    if vr in dicom.LONG_TYPES:
        return head + vr.encode() + b"\0\0" + struct.pack("<I", len(value)) + value
    return head + vr.encode() + struct.pack("<H", len(value)) + value


def sequence(tag, items, explicit=True, undefined=True):
    if undefined:
        body = b"".join(b"\xfe\xff\x00\xe0" + b"\xff" * 4 + i + b"\xfe\xff\x0d\xe0" + b"\0" * 4 for i in items)
        body += b"\xfe\xff\xdd\xe0" + b"\0" * 4
        size = 0xFFFFFFFF
    else:
        body = b"".join(b"\xfe\xff\x00\xe0" + struct.pack("<I", len(i)) + i for i in items)
        size = len(body)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + (b"SQ\0\0" if explicit else b"")
    return head + struct.pack("<I", size) + body


def dicom_file(body, syntax="1.2.840.10008.1.2.1"):
    return PREAMBLE + element(0x00020010, "UI", syntax.encode()) + body


def tags_of(spark, content):
    df = spark.createDataFrame([("f", bytearray(content))], "path string, content binary")
    return dicom.read_header_tags(df).collect()


def values(rows):
    return {r["tag"]: r["value"] for r in rows if r["depth"] == 0}


def test_value_rendering(spark):
    body = b"".join([
        element(0x00080005, "CS", b"ISO_IR 100"),
        element(0x00080008, "CS", b"DERIVED\\SECONDARY"),
        element(0x00090010, "LO", b"VENDOR"),
        element(0x00091001, "UN", bytes(range(80))),
        element(0x00100010, "PN", "J\xe9^A".encode("latin-1")),
        element(0x00200011, "IS", b" 12 "),
        element(0x00200013, "IS", b""),
        element(0x00200020, "CS", b""),
        element(0x00280010, "US", struct.pack("<H", 851)),
        element(0x00281050, "DS", b"40.5\\-3"),
        element(0x00283002, "US", struct.pack("<HHH", 256, 0, 8)),
        element(0x00720026, "AT", struct.pack("<HH", 8, 0x60)),
        element(0x00720072, "FL", struct.pack("<ff", 0.5, 2.0)),
    ])
    rows = tags_of(spark, dicom_file(body))
    assert values(rows) == {
        "(0008,0005)": "ISO_IR 100", "(0008,0008)": "['DERIVED', 'SECONDARY']", "(0009,0010)": "VENDOR",
        "(0009,1001)": bytes(range(50)).hex() + "...", "(0010,0010)": "Jé^A", "(0020,0011)": "12",
        "(0020,0013)": "None", "(0020,0020)": "", "(0028,0010)": "851", "(0028,1050)": "[40.5, -3]",
        "(0028,3002)": "[256, 0, 8]", "(0072,0026)": "(0008,0060)", "(0072,0072)": "[0.5, 2.0]",
    }
    names = {r["tag"]: r["name"] for r in rows}
    assert names["(0009,0010)"] == "Private Creator" and names["(0009,1001)"] == "Private tag data"


@pytest.mark.parametrize("explicit", [True, False])
@pytest.mark.parametrize("undefined", [True, False])
def test_nested_items(spark, explicit, undefined):
    e = lambda tag, vr, v: element(tag, vr, v, explicit)
    inner = [e(0x00080104, "LO", b"one"), e(0x00080104, "LO", b"two")]
    outer = e(0x00100010, "PN", b"N") + sequence(0x0040A043, inner, explicit, undefined)
    body = sequence(0x0040A730, [outer], explicit, undefined) + e(0x00100020, "LO", b"7")
    rows = tags_of(spark, dicom_file(body, "1.2.840.10008.1.2.1" if explicit else dicom.IMPLICIT))
    assert [(r["depth"], r["item_path"], r["tag"]) for r in rows] == [
        (0, [], "(0040,A730)"), (1, [0, 0], "(0010,0010)"), (1, [0, 0], "(0040,A043)"),
        (2, [0, 0, 1, 0], "(0008,0104)"), (2, [0, 0, 1, 1], "(0008,0104)"), (0, [], "(0010,0020)"),
    ]
    items = json.loads(rows[0]["value"])
    assert list(items[0])[:2] == ["PatientName", "PatientID"]
    assert items[0]["PatientName"] == "N" and items[0]["PatientID"] == "UNKNOWN"
    assert items[0]["(0040,A043) Concept Name Code Sequence"][1]["(0008,0104) Code Meaning"] == "two"


def test_implicit_files_beyond_the_usual_tags(spark):
    e = lambda tag, vr, v: element(tag, vr, v, False)
    long, item = b"reason " * 40 + b"end.", e(0x00080104, "LO", b"one") + e(0x00189073, "FD", struct.pack("<d", 1.5))
    body = b"".join([
        e(0x00080000, "UL", struct.pack("<I", 400)),
        sequence(0x00081032, [item, item], False, False),
        sequence(0x00089999, [item], False, False),  # in no dictionary
        e(0x00091001, "LT", long),
        e(0x0009100A, "UN", b"\xfe\xff\x00\xe0" + b"\x02\0\0\0ab"),  # starts like an item, but is none
        e(0x0010EEEE, "LT", long),  # in no dictionary
        e(0x00280103, "US", b"\1\0"),
        e(0x00280106, "SS", struct.pack("<h", -5)),
        e(0x00321030, "LO", b"fall"),
        e(0x00324000, "LT", long),
        e(0x60023000, "OW", bytes(60)),
    ])
    content = dicom_file(body, dicom.IMPLICIT)
    rows = tags_of(spark, content)
    top = {r["tag"]: r for r in rows if r["depth"] == 0}
    assert rows[0]["error"] is None and len(top) == 11
    assert {t: (r["name"], r["vr"]) for t, r in top.items() if r["name"] and t[1:5] != "0009"} == {
        "(0008,0000)": ("Group Length", "UL"), "(0008,1032)": ("Procedure Code Sequence", "SQ"),
        "(0028,0103)": ("Pixel Representation", "US"), "(0028,0106)": ("Smallest Image Pixel Value", "SS"),
        "(0032,1030)": ("Reason for Study", "LO"), "(0032,4000)": ("Study Comments", "LT"), "(6002,3000)": ("Overlay Data", "OW"),
    }
    assert top["(0032,4000)"]["value"] == long.decode() and top["(0028,0106)"]["value"] == "-5"
    assert top["(0010,EEEE)"]["value"] == top["(0009,1001)"]["value"] == long.hex()
    assert top["(0009,100A)"]["value"] == "feff00e0020000006162" and top["(6002,3000)"]["value"] == "00" * 50 + "..."
    assert top["(0008,9999)"]["vr"] == "SQ" and len(json.loads(top["(0008,1032)"]["value"])) == 2
    assert [(r["item_path"], r["value"]) for r in rows if r["depth"] == 1] == [
        ([1, 0], "one"), ([1, 0], "1.5"), ([1, 1], "one"), ([1, 1], "1.5"), ([2, 0], "one"), ([2, 0], "1.5"),
    ]
    more = spark.createDataFrame(
        [(0x0010EEEE, "LT", "History"), (0x00091001, "LT", "Vendor Note"), (0x00324000, "LT", "Renamed")], "tag_no int, vr string, name string")
    df = spark.createDataFrame([("f", bytearray(content))], "path string, content binary")
    told = {r["tag"]: r for r in dicom.read_header_tags(df, dictionary=more).collect()}
    assert {told[t]["value"] for t in ("(0010,EEEE)", "(0009,1001)", "(0032,4000)")} == {long.decode()}
    assert [told[t]["name"] for t in ("(0010,EEEE)", "(0009,1001)", "(0032,4000)")] == ["History", "[Vendor Note]", "Renamed"]


@pytest.mark.parametrize("content", [
    b"", b"DICM", b"\0" * 132, PREAMBLE[:-1] + b"X", dicom_file(element(0x00100020, "LO", b"abcdef"))[:-3],
    dicom_file(b"\x10\x00\x20\x00??\x02\x00ab"), dicom_file(sequence(0x0040A730, [b""])[:-8]),
    dicom_file(b"", dicom.BIG),
])
def test_bad_files_become_rows(spark, content):
    rows = tags_of(spark, content)
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["tag"] is None


def test_encapsulated_pixels_end_the_header(spark):
    fragment = b"\xfe\xff\x00\xe0" + struct.pack("<I", 4) + b"\1\2\3\4"
    pixels = struct.pack("<HH", 0x7FE0, 0x10) + b"OB\0\0" + b"\xff" * 4 + fragment + b"\xfe\xff\xdd\xe0" + b"\0" * 4
    body = element(0x00100020, "LO", b"7") + pixels
    rows = tags_of(spark, dicom_file(body))
    assert [r["tag"] for r in rows] == ["(0010,0020)", "(7FE0,0010)"]
    assert rows[1]["value"].startswith("feff00e0")
    df = spark.createDataFrame([("f", bytearray(dicom_file(
        element(0x00280010, "US", b"\1\0") + element(0x00280011, "US", b"\1\0") + pixels)))], "path string, content binary")
    assert dicom.read_slices(df).first()["error"] == "compressed pixel data"


def slice_rows(spark, samples, planar, data, bits=8, more=b""):
    us = lambda tag, n: element(tag, "US", struct.pack("<H", n))
    body = element(0x00080018, "UI", b"1.2") + us(0x00280002, samples) + us(0x00280006, planar)
    body += us(0x00280010, 1) + us(0x00280011, 2) + us(0x00280100, bits) + more + element(0x7FE00010, "OB", data)
    df = spark.createDataFrame([("f", bytearray(dicom_file(body)))], "path string, content binary")
    return dicom.read_slices(df).collect()


def test_slices_gray_colour_planar(spark):
    assert bytes(slice_rows(spark, 1, 0, b"\x05\x06")[0]["image"]["data"]) == b"\x05\x05\x05\x06\x06\x06"
    assert bytes(slice_rows(spark, 3, 0, b"rgbRGB")[0]["image"]["data"]) == b"bgrBGR"
    assert bytes(slice_rows(spark, 3, 1, b"rRgGbB")[0]["image"]["data"]) == b"bgrBGR"
    assert slice_rows(spark, 1, 0, b"\0\0\0\0", bits=32)[0]["error"] == "only pixels of 8 or 16 bits are supported"
    text = lambda tag, vr, v: element(tag, vr, v)
    grays = lambda *a, **k: list(bytes(slice_rows(spark, *a, **k)[0]["image"]["data"]))[::3]
    assert grays(1, 0, b"\0\0\xff\xff", bits=16) == [0, 255]
    signed = element(0x00280101, "US", b"\x0c\0") + element(0x00280103, "US", b"\1\0")
    assert grays(1, 0, b"\x00\x08\xff\x07", bits=16, more=signed) == [0, 255]  # 12 bits stored
    window = text(0x00281050, "DS", b"50\\60") + text(0x00281051, "DS", b"101 ") + text(0x00281052, "DS", b"-100") + text(0x00281053, "DS", b"2 ")
    assert grays(1, 0, b"\x4b\x64", more=window) == [129, 255]  # 2 * 75 - 100 = 50: half a step above the middle
    assert grays(1, 0, b"\0\xff", more=text(0x00280004, "CS", b"MONOCHROME1 ")) == [255, 0]
    ybr = slice_rows(spark, 3, 0, bytes([100, 128, 128, 76, 85, 255]), more=text(0x00280004, "CS", b"YBR_FULL"))[0]["image"]["data"]
    assert list(bytes(ybr)) == [100, 100, 100, 0, 0, 254]
    other = slice_rows(spark, 1, 0, b"ab", more=text(0x00280004, "CS", b"PALETTE COLOR "))[0]
    assert other["error"] == "photometric interpretation PALETTE COLOR is not supported"


def test_character_sets(spark):
    name = lambda charset, raw: {r["tag"]: r["value"] for r in tags_of(spark, dicom_file(
        element(0x00080005, "CS", charset) + element(0x00100010, "PN", raw)))}["(0010,0010)"]
    assert name(b"ISO_IR 126", b"\xc4^\xd0") == "\u0394^\u03a0"
    assert name(b"ISO_IR 192", "Å^Ü".encode()) == "Å^Ü"
    assert name(b"GB18030 ", "王^小东".encode("gb18030")) == "王^小东"
    assert name(b"\\ISO 2022 IR 87 ", "Yamada^=山田".encode("iso2022_jp")) == "Yamada^=山田"
    assert name(b"\\ISO 2022 IR 149", b"Hong=\x1b$)C" + "洪".encode("euc_kr")) == "Hong=洪"
    assert name(b"ISO_IR 999", b"ab").startswith("UNREADABLE (unknown character set ISO_IR 999")
    inner = sequence(0x0040A730, [element(0x00080005, "CS", b"ISO_IR 192") + element(0x00100010, "PN", "Å ".encode())])
    rows = tags_of(spark, dicom_file(element(0x00080005, "CS", b"ISO_IR 100") + inner + element(0x00104000, "LT", b"\xc5 ")))
    assert [r["value"] for r in rows if r["tag"] == "(0010,4000)"] == ["Å"]
    assert slice_rows(spark, 3, 0, b"\0\0")[0]["error"] == "pixel data is too short"


@pytest.fixture
def folder(tmp_path):
    """Two patients, three files, different depths; one file without magic, one too short."""
    def put(name, pid, number, broken=False):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        body = element(0x00100010, "PN", b"A^B") + element(0x00100020, "LO", pid) + element(0x00200013, "IS", number)
        path.write_bytes(dicom_file(body)[: 170 if broken else None])

    put("a.dcm", b"1", b"1")
    put("sub/dir.x/noext", b"1", b"2")
    put("sub/SC.1.2.3", b"2", b"3")
    put("sub/broken", b"3", b"4", broken=True)
    (tmp_path / "in" / "note.txt").write_bytes(b"x" * 200)
    (tmp_path / "in" / "short").write_bytes(b"DICM")
    return str(tmp_path / "in")


def test_header_flow(spark, folder, tmp_path):
    scanned = files.scan_files(spark, folder)
    assert scanned.count() == 6
    status = files.classify_files(scanned).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in status} == {"accepted": 4, "skipped": 2}
    assert files.filter_magic(scanned).count() == 4
    assert header_documents(files.filter_magic(scanned)).count() == 3
    assert header_failures(files.filter_magic(scanned)).count() == 1
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run leaves the same documents
        dump_headers(scanned, out)
        docs = spark.read.schema("patient_key string, header map<string,string>").json(out).collect()
        assert sorted(d["patient_key"] for d in docs) == ["A_B_1.json", "A_B_2.json"]


def png(a, h, w):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + a[y * w * 3 : (y + 1) * w * 3] for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_flow(spark, tmp_path):
    pixels = bytes(range(8 * 8 * 3))
    (tmp_path / "1.2_slice_1.PNG").write_bytes(png(pixels, 8, 8))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "skip.txt").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.png").write_bytes(png(pixels, 8, 8))
    read = {r["path"].rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert sorted(read) == ["1.2_slice_1.PNG", "bad.png"]
    assert read["bad.png"]["image"] is None and read["bad.png"]["error"]
    blue_first = b"".join(pixels[i : i + 3][::-1] for i in range(0, len(pixels), 3))
    assert bytes(read["1.2_slice_1.PNG"]["image"]["data"]) == blue_first

    images = files.read_images(spark, str(tmp_path)).filter("error is null").select(
        F.substring_index("path", "/", -1).alias("image_name"), "image"
    )
    rois = spark.createDataFrame([("w", 0, 0, 2, 2), ("none", 3, 3, 3, 5)], "label string, x1 int, y1 int, x2 int, y2 int")
    started = spark.sparkContext.accumulator(0)

    def make_reader():
        started.add(1)
        return lambda a: [([(0, 0), (1, 1)], f"{a.shape} {int(a.sum())}", 1.0), ([(0, 0)], "  ", 0.1)]

    rows = report(read_text(crop_images(images, rois), [chain.REGISTRY["upscaling"]], make_reader)).collect()
    rows.sort(key=lambda r: r["part"])
    assert [r["line"] for r in rows][:2] == [
        "Resultaten voor afbeelding: 1.2_slice_1_w.jpg", "Gebruikte modules: upscaling",
    ]
    assert rows[2]["line"].startswith("(4, 4, 3) ") and rows[3]["line"] == "" and len(rows) == 4
    assert started.value == 1  # the recogniser ran once for the one image


def test_ini_files(spark, tmp_path):
    path = tmp_path / "a.ini"
    path.write_text("[paths]\nIn = /x\n\n[ROI]\nroi_1 = a:1,2,3,4\n  more\n; c\nroi_2: b\nno entry\n")
    rows = ini.read_ini(ini.read_ini_text(spark, str(path))).orderBy("ord").collect()
    assert [(r["section"], r["key"], r["value"]) for r in rows] == [
        ("paths", "in", "/x"), ("ROI", "roi_1", "a:1,2,3,4\nmore"), ("ROI", "roi_2", "b"), ("ROI", None, "no entry"),
    ]


@pytest.mark.parametrize("line,want", [
    ("[2025-04-16 07:44:34] Script gestart.", ("bracket", "2025-04-16 07:44:34", None, "Script gestart.")),
    ("[Wed Apr 16 01:59:41 PM CEST 2025] Start", ("local", "2025-04-16 11:59:41", None, "Start")),
    ("[Wed Jan  1 12:30:00 AM CET 2025] x", ("local", "2024-12-31 23:30:00", None, "x")),
    ("Tue Apr  5 11:51:37 UTC 2025 - ok", ("zoned", "2025-04-05 11:51:37", None, "ok")),
    ("2025-04-15 11:51:37.495122 - err", ("micros", "2025-04-15 11:51:37.495122", None, "err")),
    ("2025-04-15 11:51:37,123 [ERROR] m", ("level", "2025-04-15 11:51:37.123", "ERROR", "m")),
    ("sitk::ERROR: no", ("cont", None, None, "sitk::ERROR: no")),
    ("[2025-13-16 07:44:34] bad month", ("bracket", None, None, "bad month")),
])
def test_log_layouts(spark, line, want):
    parsed = logs.parse_logs(spark.createDataFrame([(line,)], "value string"))
    assert tuple(parsed.select("fmt", F.col("ts").cast("string"), "level", "message").first()) == want


def test_node_lines_add_up(spark):
    lines = spark.createDataFrame([("a|/p|stopped|\n",), ("b|/q|running|12",), ("x|y|z",), ("1|2|3|4|5",), ("",)], "value string")
    good, bad = nodes.read_node_registry(lines)
    assert sorted(tuple(r) for r in good.select("label", "pid").collect()) == [("a", None), ("b", 12)]
    assert bad.count() == 3
    assert checks.accounting(lines, good.select("value"), bad.select("value")).count() == 0
    assert checks.accounting(lines, good.select("value")).count() == 3
    assert sorted(r[0] for r in sinks.registry_lines(good).collect()) == ["a|/p|stopped|", "b|/q|running|12"]


def test_ordered_text_output(spark, tmp_path):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("n")).withColumn("line", F.col("n").cast("string"))
    sinks.write_lines(df, str(tmp_path / "o"), ["n"])
    parts = sorted((tmp_path / "o").glob("part-*"))
    assert [int(x) for p in parts for x in p.read_text().split()] == list(range(1000))


def test_packed_volume_without_frames(spark):
    df = spark.createDataFrame([(None,)], "frames int").withColumn("volume", F.lit(None).cast(packed.IMAGE))
    assert packed.slices(df).first()["slice_no"] is None


def test_failures_come_from_the_same_pass(spark, tmp_path):
    from glyphray.plans.headers import dump_headers
    from glyphray.plans.images import slice_files
    from glyphray.sources import files

    (tmp_path / "in").mkdir()
    good = element(0x00080018, "UI", b"1.2") + element(0x00100010, "PN", b"A^B") + element(0x00100020, "LO", b"1")
    (tmp_path / "in" / "good.dcm").write_bytes(dicom_file(good))
    (tmp_path / "in" / "bad.dcm").write_bytes(dicom_file(b"\x10\x00\x20\x00??\x02\x00ab"))
    scanned = files.scan_files(spark, str(tmp_path / "in"))
    dump_headers(scanned, str(tmp_path / "docs"), str(tmp_path / "lost"))
    assert [r["patient_key"] for r in spark.read.json(str(tmp_path / "docs")).collect()] == ["A_B_1.json"]
    lost = spark.read.json(str(tmp_path / "lost")).collect()
    assert len(lost) == 1 and lost[0]["path"].endswith("bad.dcm") and lost[0]["error"]
    slice_files(scanned, str(tmp_path / "slices"), str(tmp_path / "unsliced"))
    assert {r["error"] for r in spark.read.json(str(tmp_path / "unsliced")).collect()} >= {"no pixel data"}


def test_files_of_tables_that_are_spread_already_are_built_where_the_rows_lie(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.coalesce(1).write.parquet(str(tmp_path / "one/orders.parquet"))
    orders.repartition(16).write.option("parquet.page.size", 1024).parquet(str(tmp_path / "many/orders.parquet"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        for key in was:
            spark.conf.set(key, "4k")
        one, many = (check_files.order_files(spark, str(tmp_path / name)) for name in ("one", "many"))
        moved = ["Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in (one, many)]
        assert moved == [True, False]
        assert one.count() == many.count() == orders.count() and one.exceptAll(many).count() == 0
        found = check_files.header_errors(spark, str(tmp_path / "many"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "_nest" not in plan and "_of_bytes" in plan  # errors are known after the cut
        bad = orders.filter("o_orderkey % 50 in (7, 9, 11)").count()
        assert found.count() == bad > 0
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
