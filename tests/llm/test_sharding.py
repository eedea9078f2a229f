import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from glyphray.llm import sharding
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def plain_shard(key, weights):
    name = "" if key is None else f"={key}"
    best = None
    for i, w in enumerate(weights):
        if w > 0:
            h = xxhash.xxh64(f"{i}/{name}", seed=42).intdigest()
            race = (-math.log(((h >> 11) + 0.5) / 2**53) / w, i)
            best = race if best is None or race < best else best
    return best[1]


@pytest.mark.parametrize("weights", [[1.0] * 16, [1, 2, 0, 3.5], [5]])
def test_winner_is_the_first_of_the_race(spark, weights):
    df = spark.createDataFrame([(i if i else None,) for i in range(3000)], "k long")
    got = sharding.assign(df, F.col("k"), weights).collect()
    assert all(r.shard == plain_shard(r.k, weights) for r in got)
    counts = Counter(r.shard for r in got)
    for i, w in enumerate(weights):
        assert abs(counts[i] - 3000 * w / sum(weights)) < 6 * math.sqrt(3000)
    with pytest.raises(ValueError):
        sharding.winner(F.col("k"), [0, 0])


def test_query(spark):
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op3_sharding"](spark, SF).collect()
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == plain_shard(r.doc_id, [1.0] * 16) and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    moved = sum(r.grown_shard == 16 for r in got)
    assert abs(moved - len(got) / 17) < 6 * math.sqrt(len(got) / 17)


@pytest.mark.parametrize("slices", [1, 7, 4096])
def test_slots_of_hard_rows(spark, monkeypatch, slices):
    monkeypatch.setattr(sharding, "SLICES", slices)
    rows = [(i % 3, i % 5 if i % 7 else None, t) for i, t in enumerate(plain.HARD * 3)] + [(1, 8, "same")] * 50
    df = spark.createDataFrame(rows, "shard int, doc_id long, text string")
    got = sharding.numbered(df, "shard").collect()
    assert Counter((r.shard, r.doc_id, r.text) for r in got) == Counter(rows)
    for s in range(3):
        n = sorted(r.slot for r in got if r.shard == s)
        assert n == list(range(len(n)))
    again = sharding.numbered(df.repartition(7), "shard").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sharding.numbered(df.limit(0), "shard").collect() == []


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, time string, weight string")
    out = sharding.assign(df, F.col("doc_id"), [1, 1])
    assert out.columns == ["doc_id", "time", "weight", "shard"]
