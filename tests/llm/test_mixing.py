import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphray.llm import mixing
from tests.llm import plain


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = {}, sum(sizes.values())
    while True:
        pull = sum(weight[s] for s in order if s not in stopped)
        left = total - sum(stopped.values())
        over = [s for s in order if s not in stopped and left * weight[s] / pull > most * sizes[s]]
        if not over:
            return {s: stopped.get(s, left * weight[s] / pull if pull else 0) for s in order}
        stopped |= {s: most * sizes[s] for s in over}


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """Times per id, for distinct ids."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    goal = plain_targets(sizes, weights, most)
    key = lambda r: (int((m := hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[2]}".encode()).hexdigest())[:6], 16) % mixing.SLICES, m)
    entries, upto = [], defaultdict(int)
    for i, s, n in sorted(rows, key=key):
        upto[s] += n
        for e in range(most):
            if goal[s] > 0 and n > 0:
                v = (e * sizes[s] + upto[s]) / goal[s]
                if v - n / goal[s] < 1:
                    entries.append((v, i, n))
    times, total = defaultdict(int), 0
    for v, i, n in sorted(entries):
        total += n
        if total > sum(sizes.values()):
            break
        times[i] += 1
    return times


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)


@pytest.mark.parametrize("bins,slices", [(4096, 4096), (4, 3)])
def test_small_mixes(spark, monkeypatch, bins, slices):
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "SLICES", slices)
    rows = [(i, [None, "a", "b", "é", "z"][min(i % 7, 4)], 1 + i * 37 % 101) for i in range(300)] + [(900, "tiny", 2), (901, "zero", 0)]
    got = mixing.mix(frame(spark, rows)).collect()
    times = plain_mix(rows)
    assert {r.doc_id: r.times for r in got} == {i: times[i] for i, _, _ in rows}
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    goal = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.size * r.times
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - goal[s]) <= 101 for s in goal)


def test_hard_tables(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r.times for r in mixing.mix(frame(spark, [(1, "a", 0), (2, None, None)])).collect()] == [0, 0]
    assert [r.times for r in mixing.mix(frame(spark, [(1, "a", 5)])).collect()] == [1]
    same = mixing.mix(frame(spark, [(1, "a", 5)] * 4 + [(None, "a", 7)])).collect()
    assert len({r.times for r in same if r.doc_id == 1}) == 1
    rows = [(i, "hot" if i % 3 else f"s{i}", 3) for i in range(200)]
    again = [sorted((r.doc_id, r.times) for r in mixing.mix(frame(spark, rows)).collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_words(spark):
    df = spark.createDataFrame([(t,) for t in plain.HARD], "text string")
    for r in df.select("text", mixing.word_count(F.col("text")).alias("n")).collect():
        assert r.n == len(plain.words(r.text))


def test_rows_of_the_mix(spark):
    rows = [(i, "a" if i < 8 else "b", "word " * (i + 1), i) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    times = plain_mix([(i, s, i + 1) for i, s, _, _ in rows])
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}
