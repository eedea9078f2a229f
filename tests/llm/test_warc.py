import gzip
import hashlib
import json
import zlib

import pytest

from glyphray.llm import warc
from tests.llm import plain


def record(name, body, kind="response"):
    head = warc._head({"WARC-Type": kind, "WARC-Record-ID": warc.record_id(name), "X-Payload-Length": str(len(body)),
                       "WARC-Payload-Digest": f"sha1:{hashlib.sha1(body).hexdigest()}"}, len(body))
    return head + body + b"\r\n\r\n"


BODIES = [b"", b"x", b"\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", bytes(range(256)) * 50, b"a" * 3_000_000]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
@pytest.mark.parametrize("members", [False, True])
def test_normalised_members_are_the_records(tmp_path, monkeypatch, chunk, members):
    bodies = BODIES if chunk > 7 else BODIES[:-1]
    monkeypatch.setattr(warc, "CHUNK", chunk)
    records = [record(i, b) for i, b in enumerate(bodies)]
    whole = b"".join(map(gzip.compress, records)) if members else gzip.compress(b"".join(records))
    (tmp_path / "in.gz").write_bytes(whole)
    count, index = warc.normalise_file(f"file://{tmp_path}/in.gz", f"file://{tmp_path}/out.gz")
    raw = (tmp_path / "out.gz").read_bytes()
    lines = [json.loads(x) for x in (tmp_path / "out.gz.idx").read_text().splitlines()]
    assert count == len(records) == len(lines)
    assert gzip.decompress(raw) == b"".join(records)
    for line, r in zip(lines, records, strict=True):
        machine = zlib.decompressobj(wbits=31)
        assert machine.decompress(raw[line["offset"]:line["offset"] + line["length"]]) == r
        assert machine.eof and not machine.unused_data
    assert sum(x["length"] for x in lines) == len(raw)


def test_damage_is_an_error(tmp_path):
    whole = gzip.compress(record(1, b"abc" * 1000) + record(2, b"q"))
    for bad in (whole[:-20], gzip.compress(record(1, b"abc")[:-10]), gzip.compress(b"nonsense\r\n\r\n")):
        (tmp_path / "in.gz").write_bytes(bad)
        with pytest.raises((ValueError, zlib.error)):
            warc.normalise_file(f"file://{tmp_path}/in.gz", f"file://{tmp_path}/out.gz")


def test_hard_pages(spark):
    big = "é" * 600
    rows = [(1, "http://a/b c\r\nX: y", t) for t in plain.HARD]
    rows = [(i, u, t) for i, (_, u, t) in enumerate(rows)]
    rows += [(100, None, big), (101, "u", big), (102, "u", big), (None, "u", big), (102, "u", big), (103, "u", "s"), (104, "u", "s")]
    rows += [(None, "n", "z" * 2000), (None, "n", "z" * 2000)]
    df = spark.createDataFrame([(i, u, t, 1) for i, u, t in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(rows)
    wanted = []
    for i, _, t in rows:
        body = (t or "").encode()
        same = [j for j, _, x in rows if (x or "") == (t or "")]
        first = max((j for j in same if j is not None), default=None)
        again = len(body) >= 1000 and len(same) > 1 and first is not None and i != first
        wanted.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None,
                       b"" if again else body))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=repr) == sorted(wanted, key=repr)
    assert warc.archive_and_read(df.limit(0)).collect() == []


def test_single_record_by_its_place(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string")
    folder = warc.shared_folder(spark, "warc-test")
    normal = warc.normalise(warc.write_archives(warc.decide(df), f"{folder}/a"), f"{folder}/b")
    one = warc.read_index(normal).filter("id = '<urn:page:17>'")
    assert [bytes(r.payload) for r in warc.read_records(one).collect()] == [b"page 17"]
