"""Principal components and whitening of vectors on an integer grid.

Vectors are put on a grid of integers first, so all sums over rows are exact: they do not depend on how rows are spread
over tasks, and a task that runs twice gives the same. The centred scatter is then factored by a pivoted Cholesky
decomposition, and a one-sided Jacobi iteration rotates the columns of the triangular factor until they are orthogonal.
Their squared norms are the eigenvalues, and the normalised columns are the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.llm.store import stored

# Doubles hold every integer up to this one.
_EXACT = 1 << 53
_INT64 = 1 << 63
SWEEPS = 60


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def on_grid(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """``floor(scale * c) + shift`` of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


@dataclass(frozen=True)
class Model:
    """``n`` vectors with integer sums ``sums``; ``values`` fall, ``components`` has one row for each of them."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


# --- the factorisation, on one matrix of the vectors' dimension ---------------------------------


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """Columns ``l`` with ``l @ l.T`` equal to ``scatter``, one for each pivot above rounding.

    Every step takes the largest diagonal entry that is left, so the columns fall in size and a matrix without full rank
    gives fewer of them.
    """
    d = len(scatter)
    rest = np.diag(scatter).astype(np.float64)
    factor = np.zeros((d, d))
    floor = d * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        at = int(np.argmax(rest))
        if rest[at] <= floor:
            return factor[:, :k]
        column = (scatter[:, at] - factor[:, :k] @ factor[at, :k]) / math.sqrt(rest[at])
        factor[:, k] = column
        rest = rest - column * column
        rest[at] = 0.0
    return factor


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of ``factor @ factor.T``.

    Pairs of columns are rotated until they are orthogonal. A round of a tournament pairs every column with one other, so
    a round is a few array operations; ``r - 1`` rounds are a sweep.
    """
    d, r = factor.shape
    width = r + r % 2
    work = np.zeros((d, width))
    work[:, :r] = factor
    seats = np.arange(width)
    for _ in range(SWEEPS if width else 0):
        turned = 0.0
        for _ in range(width - 1):
            p, q = seats[: width // 2], seats[width // 2:][::-1]
            a, b = work[:, p], work[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            skew = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            turned = max(turned, float(skew.max()))
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=gamma != 0)
            t = np.where(gamma != 0, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            work[:, p], work[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if turned < 4 * np.finfo(np.float64).eps:
            break
    norms = np.sqrt((work * work).sum(axis=0))[:width]
    order = np.argsort(-norms, kind="stable")[:r]
    order = order[norms[order] > 0]
    return norms[order] ** 2, work[:, order] / norms[order]


# --- sums over all rows, exact ------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of ``d`` integers each."""
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _totals(x: np.ndarray) -> np.ndarray:
    """Sum of every column, as Python integers."""
    fits = int(np.abs(x).max(initial=0)) * len(x) < _INT64
    return (x.sum(axis=0) if fits else x.astype(object).sum(axis=0)).astype(object)


def _gram(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` without rounding, as Python integers.

    Products of doubles are exact as long as every sum stays below 2^53; blocks are as tall as that allows.
    """
    top = int(np.abs(z).max(initial=0))
    tall = _EXACT // (top * top) if top else len(z)
    if tall < 1:
        wide = z.astype(object)
        return wide.T @ wide
    total = np.zeros((z.shape[1],) * 2, object)
    for at in range(0, len(z), max(1, min(tall, 1 << 16))):
        block = z[at:at + max(1, min(tall, 1 << 16))].astype(np.float64)
        total = total + (block.T @ block).astype(np.int64).astype(object)
    return total


def _summed(vectors: DataFrame, partial: Callable[[pa.Array], np.ndarray], length: int) -> list[int]:
    """Sum over all rows of ``partial``, which gives ``length`` integers for a batch.

    A task sends one row for each number; they are added in decimals of 38 digits and only ``length`` sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = partial(batch.column("x"))
            total = part if total is None else total + part
        if total is not None:
            values = pa.array([int(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), values], ["at", "v"])

    rows = vectors.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = [0] * length
    for row in rows:
        sums[row.at] = int(row.v)
    return sums


def fit(vectors: DataFrame) -> Model:
    """Model of all rows of ``x`` (array of long, all of one length). Two passes: sums, then the centred scatter.

    Rows are centred on the rounded mean, in integers, before they are multiplied; what the rounding leaves of the mean (less
    than a half) is taken out of the exact sums. Only the sums (one for each pair of dimensions) reach the driver. Without
    rows the model is empty.
    """
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = int(size.n), int(size.d or 0)
    if not n or not d:
        return Model(n, [], np.zeros(0), np.zeros((0, d)), 0.0)
    sums = _summed(vectors, lambda x: _totals(_matrix(x, d)), d)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    upper = np.triu_indices(d)
    around = np.array(middle, np.int64)
    products = _summed(vectors, lambda x: _gram(_matrix(x, d) - around)[upper], len(upper[0]))
    scatter = np.zeros((d, d))
    for i, j, v in zip(*map(np.ndarray.tolist, upper), products, strict=True):
        scatter[i, j] = scatter[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    values, components = one_sided_jacobi(pivoted_cholesky(scatter))
    return Model(n, sums, values, components.T, float(np.trace(scatter)))


def whiten(vectors: DataFrame, model: Model, most: int) -> DataFrame:
    """Every row of ``vec_id, x`` with ``deviation`` and ``whitened``, an array of up to ``most`` numbers.

    ``whitened``: ``x`` less the mean, projected on the leading components and divided by the root of their eigenvalues.
    ``deviation``: sum over dimensions of ``(n * x - sum)^2``, exact; null where it does not fit a long. One pass.
    """
    k = min(most, len(model.values))
    d = len(model.sums)
    project = (model.components[:k] / np.sqrt(model.values[:k])[:, None]).T if k else np.zeros((d, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, object)
        small = max(map(abs, model.sums), default=0) < _INT64 // 4
        for batch in batches:
            x = _matrix(batch.column("x"), d) if d else np.zeros((len(batch), 0), np.int64)
            if small and model.n * int(np.abs(x).max(initial=0)) < _INT64 // 4:
                moved = x * model.n - sums.astype(np.int64)
                top = int(np.abs(moved).max(initial=0))
            else:
                top, moved = _INT64, x.astype(object) * model.n - sums
            if top * top * max(d, 1) >= _INT64:
                moved = moved.astype(object)
            squares = [int(v) for v in (moved * moved).sum(axis=1)] if d else [0] * len(x)
            centred = moved.astype(np.float64) / model.n
            white = centred @ project
            offsets = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([v if v < _INT64 else None for v in squares], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64()))], ["vec_id", "deviation", "whitened"]
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, k: int) -> DataFrame:
    """One row ``identity_error``: how far the covariance of ``whitened`` (``k`` long) is from the identity, at most.

    Means first, then products of centred numbers: two passes over narrow rows, each combined before the shuffle.
    """
    at = lambda i: F.get("whitened", F.lit(i))
    means = white.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(k)])
    centred = white.crossJoin(F.broadcast(means)).select(*[(at(i) - F.col(f"m{i}")).alias(f"c{i}") for i in range(k)])
    off = [F.abs(F.avg(F.col(f"c{i}") * F.col(f"c{j}")) - float(i == j)) for i in range(k) for j in range(i, k)]
    return centred.agg(F.array_max(F.array(*off)).alias("identity_error"))


def components(rows: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row of ``vec_id, embedding``.

    Components are numbered from 1 by falling eigenvalue, ``most`` at most. Rows whose vector is null or has null or
    non-finite entries are left out; a shorter vector counts as filled up with zeros. Repeated rows count and are answered
    each, null ids stay, more columns are ignored. Where the vectors have fewer independent directions than ``most`` there
    are fewer components: none if all vectors are equal, so that there are no rows then.
    """
    usable_rows = rows.select("vec_id", "embedding").filter(usable(F.col("embedding")))
    longest = usable_rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first().d
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.lit(longest) - F.size("embedding"))
    filled = F.when(F.size("embedding") == longest, F.col("embedding")).otherwise(F.concat("embedding", zero))
    vectors = usable_rows.select("vec_id", on_grid(filled, scale, shift).alias("x"))
    model = fit(vectors)
    k = min(most, len(model.values))
    if not k:
        empty = whiten(vectors, model, most).filter(F.lit(False))
        return empty.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation",
                            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    white = stored(whiten(vectors, model, most), "whitened")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]])
    return (
        white.crossJoin(F.broadcast(stored(identity_error(white, k), "whitened-error")))
        .select("vec_id", "deviation", "identity_error", F.posexplode("whitened").alias("at", "white"))
        .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                F.col("white").alias("whitened"), F.get(explained, F.col("at")).alias("explained"), "identity_error")
    )
