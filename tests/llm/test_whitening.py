import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphray.llm import whitening
from glyphray.llm.queries import op11

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain_model(x):
    """Exact covariance by fractions, then eigenvalues (falling) and eigenvectors (rows) of it in doubles."""
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    cov = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    return mean, values[::-1], vectors.T[::-1], float(np.trace(cov))


def check(got, rows, most=8):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v + [0.0] * (d - len(v))] for _, v in kept]
    mean, values, vectors, trace = plain_model(x)
    rank = int((values > values[0] * 1e-12).sum())
    assert len(got) == len(kept) * min(most, rank)
    sums = [sum(c) for c in zip(*x, strict=True)]
    by = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for (i, _), v in zip(kept, x, strict=True):
        centred = np.array([float(c - m) for c, m in zip(v, mean, strict=True)])
        for k in range(min(most, rank)):
            r = by[i, k + 1]
            assert r.n == len(x) and r.deviation == sum((len(x) * c - s) ** 2 for c, s in zip(v, sums, strict=True))
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)
            assert 0 <= r.identity_error <= 1e-6
            want = centred @ vectors[k] / math.sqrt(values[k])
            if abs(want) > 1e-3:
                assert sign.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
    assert len({r.identity_error for r in got}) == 1


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(3)
    spread = np.array([3.0, 2.0, 1.4, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1])
    rows = [(i, [float(c) for c in rng.normal(size=10) * spread], 0) for i in range(150)]
    rows += [(1000 + i, [0.5] * 10, 0) for i in range(60)]  # a third are one vector
    rows += [(2000, None, 0), (2001, [1.0] * 9 + [None], 0), (2002, [float("nan")] * 10, 0), (2003, [float("-inf")] + [0.0] * 9, 0)]
    check(whitening.components(frame(spark, rows)).collect(), rows)


def test_few_directions_and_short_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(b), 0.25, float(a)], 0) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    check(whitening.components(frame(spark, rows)).collect(), rows)
    rows += [(90, [1.5], 0), (91, [], 0)]
    check(whitening.components(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.25], 0)], [(i, [0.5, 0.25], 0) for i in range(9)], [(1, [None], 0)],
])
def test_nothing_to_whiten(spark, rows):
    got = whitening.components(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, [0.5, 1.0], 0)] * 3 + [(4, [2.0, -1.0], 0)] * 2 + [(5, [0.25, 3.0], 0)]
    df = frame(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("x", "component", "whitened", "n", "at", "v")])
    got = whitening.components(df).collect()
    assert len(got) == 12 and sum(r.vec_id is None for r in got) == 6 and {r.n for r in got} == {6}


def test_sums_do_not_depend_on_the_spread_of_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=6)], 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", whitening.on_grid(F.col("embedding")).alias("x"))
    a, b = whitening.fit(df.repartition(7)), whitening.fit(df.coalesce(1))
    assert a.sums == b.sums and (a.values == b.values).all() and (a.components == b.components).all()


def test_products_beyond_doubles_are_exact():
    z = np.array([[3_000_000_019, 5], [-2_999_999_999, 7], [1, 1]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]
    assert whitening._gram(z).tolist() == want
    small = np.random.default_rng(1).integers(-(1 << 25), 1 << 25, (50, 3))
    assert whitening._gram(small).tolist() == [[sum(int(r[i]) * int(r[j]) for r in small) for j in range(3)] for i in range(3)]


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [3_100_000_000, 0]), (2, [0, 0])], "vec_id long, x array<long>")
    got = whitening.whiten(df, whitening.fit(df), 2).collect()
    assert [r.deviation for r in got] == [None, None]
    wide = spark.createDataFrame([(1, [1 << 62, 0]), (2, [0, 1])], "vec_id long, x array<long>")
    assert [r.deviation for r in whitening.whiten(wide, whitening.fit(wide), 2).collect()] == [None, None]


def test_factorisation():
    rng = np.random.default_rng(0)
    for d, r in ((64, 64), (64, 5), (1, 1), (7, 7)):
        a = rng.normal(size=(d, r)) * np.logspace(0, 3, r)
        s = a @ a.T
        values, vectors = whitening.one_sided_jacobi(whitening.pivoted_cholesky(s))
        assert len(values) == r
        assert np.allclose(values, np.linalg.eigvalsh(s)[::-1][:r], rtol=1e-6)
        assert np.abs(vectors.T @ vectors - np.eye(r)).max() < 1e-12
    assert len(whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.zeros((3, 3))))[0]) == 0


def test_query(spark):
    got = op11(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    x = np.array([[math.floor(1024 * float(c)) for c in v] for _, v, _ in rows], np.float64)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    white = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(len(rows), 8)
    order = np.argsort([i for i, *_ in rows])
    want = ((x - x.mean(axis=0)) @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8]))[order]
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)
    assert {r.component: r.explained for r in got} == pytest.approx({k + 1: v / values.sum() for k, v in enumerate(values[::-1][:8])})
