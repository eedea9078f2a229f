"""Streams over real folders: arrival rule, archive, retries, restart."""

import time

import pytest

from glyphray.streaming import arrivals
from glyphray.streaming.keyed import KeyedTable
from glyphray.streaming.runner import drain
from tests.test_files import dicom_file, element


def header(pid, number):
    return dicom_file(element(0x00100010, "PN", b"A^B") + element(0x00100020, "LO", pid) + element(0x00200013, "IS", number))


def test_arrival_trigger_is_flat_and_selective(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.dcm", "b.DCM", "noext", "SC.1.2", "sub/c.dcm"):
        (tmp_path / "in" / name).write_bytes(b"x")
    got = drain(spark, arrivals.arrivals(arrivals.new_files(spark, str(tmp_path / "in"))).select("path"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.dcm", "noext"]


def test_header_stream_keeps_latest_and_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, state = str(tmp_path / "t"), str(tmp_path / "c")
    run = lambda: arrivals.start_header_stream(arrivals.new_files(spark, str(folder), 1), table, state).awaitTermination()
    (folder / "one").write_bytes(header(b"1", b"1"))
    (folder / "bad").write_bytes(b"y" * 300)
    run()
    time.sleep(1.1)  # a later modification time
    (folder / "two").write_bytes(header(b"1", b"2"))
    (folder / "three").write_bytes(header(b"9", b"3"))
    run()
    run()  # nothing new: nothing happens
    assert spark.read.parquet(table).count() == 3
    docs = {r["patient_key"]: r["header"]["(0020,0013) Instance Number"] for r in arrivals.current_headers(spark, table).collect()}
    assert docs == {"A_B_1.json": "2", "A_B_9.json": "3"}


def test_drain_without_input_and_in_other_modes(spark, tmp_path):
    (tmp_path / "none").mkdir()
    files = arrivals.new_files(spark, str(tmp_path / "none"))
    assert drain(spark, files.groupBy("path").count(), "complete").collect() == []
    with pytest.raises(ValueError):
        drain(spark, files.groupBy("path").count(), "update")


def test_hand_over_archives(spark, tmp_path):
    send = tmp_path / "Send"
    send.mkdir()
    (send / "f1").write_bytes(b"1")
    out, state = str(tmp_path / "queue"), str(tmp_path / "c")

    def run():
        moved = arrivals.hand_over(arrivals.new_files(spark, str(send), archive=str(tmp_path / "archive")))
        moved.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()

    run()
    (send / "f2").write_bytes(b"2")
    run()
    events = spark.read.parquet(out)
    assert sorted((r["file"], r["folder"], r["event"]) for r in events.collect()) == [
        ("f1", "Queue", "arrived"), ("f2", "Queue", "arrived"),
    ]


def test_keyed_table_stays_small_and_takes_replays(spark, tmp_path):
    path = str(tmp_path / "live")
    schema = spark.createDataFrame([], "node long, status string, ts long").schema
    live = KeyedTable(spark, path, schema, ["node"], ["ts"], buckets=2, every=3)
    assert live.read().collect() == []
    rows = lambda: {r.node: (r.status, r.ts) for r in live.read().collect()}
    want = {}
    for batch in range(9):
        new = [(batch % 4, f"s{batch}", batch), (9, f"old{batch}", 100 - batch), (None, f"n{batch}", batch)]
        frame = spark.createDataFrame(new, schema)
        live.merge(frame, batch)
        live.merge(frame, batch)  # a replay
        for node, status, ts in new:
            want[node] = max(want.get(node, ("", -1)), (status, ts), key=lambda v: v[1])
    assert rows() == want
    for batch in (0, 4):  # long merged
        live.merge(spark.createDataFrame([(77, "late", 1)], schema), batch)
    assert rows() == want
    assert len(list((tmp_path / "live").rglob("part-*.parquet"))) <= 2 * 2 + 2 * 3 * 2
    (tmp_path / "live" / "delta" / "50").mkdir(parents=True)  # a write that never ended
    assert rows() == want


def test_header_table_and_failures(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table = arrivals.header_table(spark, str(tmp_path / "t"), buckets=2, every=2)
    failed = str(tmp_path / "failed")

    def run():
        stream = arrivals.new_files(spark, str(folder), 1)
        arrivals.start_header_table(stream, table, failed, str(tmp_path / "c")).awaitTermination()
        return {r["patient_key"]: r["header"]["(0020,0013) Instance Number"] for r in table.read().collect()}

    (folder / "one").write_bytes(header(b"1", b"1"))
    (folder / "bad").write_bytes(header(b"1", b"1")[:-1])
    assert run() == {"A_B_1.json": "1"}
    time.sleep(1.1)
    (folder / "two").write_bytes(header(b"1", b"2"))
    (folder / "three").write_bytes(header(b"9", b"3"))
    assert run() == {"A_B_1.json": "2", "A_B_9.json": "3"} == run()
    assert [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(failed).collect()] == ["bad"]


def test_arriving_files_come_in_bounded_batches_and_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "FILES", 40)
    folder, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    folder.mkdir()
    for i in range(100):
        (folder / str(i)).write_bytes(header(str(i).encode(), b"1") if i % 10 else b"y" * 300)
    spark.conf.set(arrivals.LOOK_UP, 10_000)
    try:
        started = arrivals.start_header_stream(arrivals.new_files(spark, str(folder)), table, state)
        started.awaitTermination()
        assert int(spark.conf.get(arrivals.LOOK_UP)) == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset(arrivals.LOOK_UP)
    assert [p["numInputRows"] > 0 for p in started.recentProgress] == [True] * 3
    assert spark.read.parquet(table).select("batch").distinct().count() == 3
    assert spark.read.parquet(table).count() == 90
    assert arrivals.current_headers(spark, table).count() == 90
