"""Files read by ranges: same answers, fewer bytes."""

import pytest
from pyspark.sql import functions as F

from glyphray.plans.headers import header_results, header_results_by_path
from glyphray.sources import dicom, files, ranges
from tests.test_files import dicom_file, element


@pytest.fixture
def folder(tmp_path):
    pixels = b"\x01\x02" * 2_000_000
    long_text = b"x" * 40_000
    body = element(0x00100010, "PN", b"A^B") + element(0x00100020, "LO", b"7")
    (tmp_path / "big one.dcm").write_bytes(dicom_file(body + element(0x7FE00010, "OW", pixels)))
    (tmp_path / "after").write_bytes(
        dicom_file(body + element(0x7FE00010, "OW", pixels) + element(0xFFFCFFFC, "OB", b"\0" * 10)))
    (tmp_path / "text").write_bytes(dicom_file(body + element(0x00204000, "UT", long_text)))
    (tmp_path / "cut").write_bytes(dicom_file(body + element(0x7FE00010, "OW", pixels))[:-1000])
    (tmp_path / "short").write_bytes(b"\0" * 131)
    (tmp_path / "other").write_bytes(b"y" * 100_000)
    return tmp_path


def test_same_tags_from_fewer_bytes(spark, folder):
    scanned = files.scan_files(spark, str(folder))
    lazy = dicom.with_header_by_path(scanned.drop("content"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(dicom.tag_rows(lazy)) == rows(dicom.read_header_tags(scanned))
    read = {r.path.rsplit("/", 1)[1]: (r.bytes_read, r.length) for r in lazy.collect()}
    assert read["big one.dcm"][0] <= 2 * ranges.PAGE < read["big one.dcm"][1] / 100
    assert read["after"][0] <= 3 * ranges.PAGE  # elements behind the pixels are still read
    assert read["text"][0] >= 40_000 and read["other"][0] <= ranges.PAGE


def test_scan_without_content_reads_nothing(spark, folder):
    plan = dicom.with_header_by_path(files.scan_files(spark, str(folder)).drop("content"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_magic_by_range(spark, folder):
    scanned = files.scan_files(spark, str(folder))
    got = {r.path.rsplit("/", 1)[1]: r.accepted for r in ranges.with_magic(scanned).collect()}
    assert got == {r.path.rsplit("/", 1)[1]: r.ok for r in scanned.withColumn("ok", files.has_magic(F.col("content"))).collect()}


def test_documents_and_failures(spark, folder):
    scanned = files.scan_files(spark, str(folder))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(header_results_by_path(scanned)) == rows(header_results(files.filter_magic(scanned)))
    gone = scanned.select(F.concat("path", F.lit("-gone")).alias("path"), "modificationTime", "length").filter("length > 200")
    lost = header_results_by_path(gone).collect()
    assert len(lost) == 5 and all(r.header is None and r.error.startswith("could not be opened") for r in lost)
    assert [r.bytes for r in gone.limit(1).select(ranges.read_range(F.lit("nofs://x/y"), 0, 4).alias("r")).select("r.*").collect()] == [None]


def test_slices_of_a_range(folder):
    data = (folder / "big one.dcm").read_bytes()
    with ranges.Ranged(f"file:{folder}/big one.dcm") as file:
        for a, b in ((0, 4), (ranges.PAGE - 2, ranges.PAGE + 2), (5, 3 * ranges.PAGE), (len(data) - 3, len(data) + 50), (9, 9), (9, 2)):
            assert file[a:b] == data[a:b]
