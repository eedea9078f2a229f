"""Image operators on the pixel table.

A gray image is rows ``(keys..., height, width, y, x, p)``; a colour image has ``b, g, r`` in place
of ``p``. Height and width travel with every row so that no operator joins for them. Windows are
partitioned by one image line or column, never by a whole image: a giant image spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("image_id",)
CUBIC_A = -0.75


def _grid(keys: Sequence[str]) -> list[str]:
    return [*keys, "height", "width", "y", "x"]


# --- point operators -------------------------------------------------------------------------


def to_rgb(df: DataFrame) -> DataFrame:
    """Gray to colour: the value in all three channels."""
    p = F.col("p")
    return df.withColumns({"b": p, "g": p, "r": p}).drop("p")


def gray_value(b: Column, g: Column, r: Column) -> Column:
    """Weighted sum in thousandths, rounded once, half up."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def to_gray(df: DataFrame) -> DataFrame:
    return df.withColumn("p", gray_value(F.col("b"), F.col("g"), F.col("r"))).drop("b", "g", "r")


def swap_channels(df: DataFrame) -> DataFrame:
    return df.withColumns({"b": F.col("r"), "r": F.col("b")})


def threshold(df: DataFrame, level: int = 127) -> DataFrame:
    if not 0 <= level <= 255:
        raise ValueError("level must lie in 0..255")
    return df.withColumn("p", F.when(F.col("p") > level, 255).otherwise(0))


def fit_scale(width: Column, height: Column, box_w: int, box_h: int, shrink: float = 1.0) -> Column:
    """Preview size that fits a box, with an optional second shrink; both steps truncate."""
    s = F.least(F.lit(float(box_w)) / width, F.lit(float(box_h)) / height)
    w, h = (width * s).cast("int"), (height * s).cast("int")
    if shrink != 1.0:
        w, h = (w * F.lit(shrink)).cast("int"), (h * F.lit(shrink)).cast("int")
    return F.struct(w.alias("fit_w"), h.alias("fit_h"))


# --- neighbourhoods --------------------------------------------------------------------------


def _axis(axis: str) -> tuple[str, str]:
    return ("x", "width") if axis == "x" else ("y", "height")


def pad_border(df: DataFrame, axis: str, before: int, after: int, mode: str = "replicate") -> DataFrame:
    """Extend every image along one axis so that plain row frames need no edge cases.

    ``replicate`` repeats the edge; ``reflect101`` mirrors without repeating it, again and again
    where the radius exceeds the image. Only edge pixels are multiplied.
    """
    pos, size = _axis(axis)
    at, n = F.col(pos), F.col(size)
    none = F.array().cast("array<int>")
    here = F.array(at)
    if mode == "replicate":
        spots = F.concat(
            here,
            F.when(at == 0, F.sequence(F.lit(-before), F.lit(-1))).otherwise(none) if before else none,
            F.when(at == n - 1, F.sequence(n, n + (after - 1))).otherwise(none) if after else none,
        )
        inner = (at > 0) & (at < n - 1)
    elif mode == "reflect101":
        period = (n - 1) * 2
        last = n - 1 + after

        def images_of(offset: Column) -> Column:
            start = F.pmod(offset + before, period) - before
            return F.when(start <= last, F.sequence(start, last, period)).otherwise(none)

        spots = F.when(n == 1, F.sequence(F.lit(-before), F.lit(after))).otherwise(
            F.array_union(images_of(at), images_of(-at))
        )
        inner = (at > before) & (at < n - 1 - after)
    else:
        raise ValueError(f"unknown border mode {mode!r}")
    # never empty: the outer form spares the plan a filter on the array's size
    return df.withColumn(pos, F.explode_outer(F.when(inner, here).otherwise(spots)))


def _line(keys: Sequence[str], axis: str):
    pos, _ = _axis(axis)
    other = "y" if axis == "x" else "x"
    return Window.partitionBy(*keys, other).orderBy(pos)


def _inside(axis: str) -> Column:
    pos, size = _axis(axis)
    return (F.col(pos) >= 0) & (F.col(pos) < F.col(size))


def box_sum(df: DataFrame, radius: int, keys: Sequence[str] = KEYS, col: str = "p", out: str = "s") -> DataFrame:
    """Sum over the (2r+1)-square around each pixel, replicated border, one axis after the other."""
    src = col
    for axis in ("x", "y"):
        frame = _line(keys, axis).rowsBetween(-radius, radius)
        df = (
            pad_border(df, axis, radius, radius)
            .withColumn(out, F.sum(F.col(src).cast("bigint")).over(frame))
            .filter(_inside(axis))
        )
        src = out
    return df


def box_mean(df: DataFrame, radius: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rounded (half up) local mean as ``mean``."""
    n = (2 * radius + 1) ** 2
    return (
        box_sum(df, radius, keys)
        .withColumn("mean", F.floor((F.col("s") * 2 + n) / (2 * n)).cast("int"))
        .drop("s")
    )


def adaptive_threshold(df: DataFrame, block: int = 3, c: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """White where the pixel exceeds its local mean minus ``c``; even blocks grow by one."""
    return (
        box_mean(df, (block | 1) // 2, keys)
        .withColumn("p", F.when(F.col("p") > F.col("mean") - c, 255).otherwise(0))
        .drop("mean")
    )


def gaussian_weights(v: int) -> list[int]:
    """Kernel of size 2v+1, sigma derived from the size, as integers summing to 65536."""
    k = 2 * v + 1
    sigma = 0.3 * ((k - 1) / 2 - 1) + 0.8
    raw = [math.exp(-((i - v) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    w = [int(math.floor(65536 * x / sum(raw) + 0.5)) for x in raw]
    w[v] += 65536 - sum(w)
    return w


def gaussian_blur(df: DataFrame, v: int = 1, keys: Sequence[str] = KEYS, cols: Sequence[str] = ("p",)) -> DataFrame:
    """Separable blur with mirrored border; integer sums, one rounding at the end (half up)."""
    weights = gaussian_weights(v)
    for axis in ("x", "y"):
        line = _line(keys, axis)

        def weighted(name: str) -> Column:
            at = F.col(name).cast("bigint")
            terms = [
                (F.lag(at, v - i) if i < v else F.lead(at, i - v) if i > v else at)
                for i in range(2 * v + 1)
            ]
            total = None
            for i, (term, w) in enumerate(zip(terms, weights)):
                part = (term if i == v else term.over(line)) * F.lit(w).cast("bigint")
                total = part if total is None else total + part
            return total

        df = (
            pad_border(df, axis, v, v, "reflect101")
            .withColumns({c: weighted(c) for c in cols})
            .filter(_inside(axis))
        )
    # 65536 squared is 2**32; adding half of it first rounds half up
    return df.withColumns(
        {c: F.shiftright(F.col(c) + F.lit(1 << 31), 32).cast("int") for c in cols}
    )


def odd_kernel(k: int) -> int:
    return k + 1 if k % 2 == 0 else k


def median_blur(df: DataFrame, k: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Middle value of the k-square, replicated border; even k grows by one.

    Neighbours travel as bounded arrays inside window frames, so pixels are never multiplied.
    """
    k = odd_kernel(k)
    r = k // 2
    df = df.withColumn("near", F.col("p"))
    for axis in ("x", "y"):
        frame = _line(keys, axis).rowsBetween(-r, r)
        df = (
            pad_border(df, axis, r, r)
            .withColumn("near", F.collect_list("near").over(frame))
            .filter(_inside(axis))
        )
    middle = F.get(F.sort_array(F.flatten("near")), F.lit(k * k // 2))
    return df.withColumn("p", middle).drop("near")


def _cubic_weights(t: Column) -> list[Column]:
    """Weights in 1/256 of the four taps around fraction ``t``; the second tap takes the remainder."""
    a = CUBIC_A

    def near(d: Column) -> Column:
        return ((a + 2) * d - (a + 3)) * d * d + 1

    def far(d: Column) -> Column:
        return ((a * d - 5 * a) * d + 8 * a) * d - 4 * a

    q = lambda w: F.floor(w * 256 + 0.5).cast("bigint")
    w0, w2, w3 = q(far(t + 1)), q(near(1 - t)), q(far(2 - t))
    return [w0, F.lit(256).cast("bigint") - w0 - w2 - w3, w2, w3]


def upscale(df: DataFrame, factor: float = 2, keys: Sequence[str] = KEYS, cols: Sequence[str] = ("p",)) -> DataFrame:
    """Cubic resize to ``int(size * factor)``, replicated border, clamped and rounded once."""
    f = F.lit(float(factor))
    for axis in ("x", "y"):
        pos, size = _axis(axis)
        line = _line(keys, axis)
        at = F.col(pos)
        # every pixel serves the outputs whose source coordinate falls in [at, at + 1)
        lo = F.ceil((at + 0.5) * f - 0.5).cast("int")
        hi = (F.ceil((at + 1.5) * f - 0.5) - 1).cast("int")
        new_size = (F.col(size) * f).cast("int")
        first, last = F.greatest(lo, F.lit(0)), F.least(hi, new_size - 1)
        outs = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        taps = {}
        for c in cols:
            v = F.col(c).cast("bigint")
            taps[f"__{c}"] = F.array(F.lag(v, 1).over(line), v, F.lead(v, 1).over(line), F.lead(v, 2).over(line))
        df = (
            pad_border(df, axis, 2, 2)
            .withColumns(taps)
            .filter((F.col(pos) >= -1) & (F.col(pos) < F.col(size)))
            .withColumn("__out", F.explode(outs))
        )
        w = F.array(*_cubic_weights((F.col("__out") + 0.5) / f - 0.5 - F.col(pos)))
        df = (
            df.withColumn("__w", w)
            .withColumns(
                {
                    c: sum((F.get(f"__{c}", F.lit(i)) * F.get("__w", F.lit(i)) for i in range(1, 4)),
                           F.get(f"__{c}", F.lit(0)) * F.get("__w", F.lit(0)))
                    for c in cols
                }
            )
            .withColumns({pos: F.col("__out"), size: (F.col(size) * f).cast("int")})
            .drop("__out", "__w", *taps)
        )
    rounded = lambda c: F.shiftright(F.col(c) + F.lit(1 << 15), 16)
    return df.withColumns(
        {c: F.greatest(F.least(rounded(c), F.lit(255)), F.lit(0)).cast("int") for c in cols}
    )


def tuned_filter(df: DataFrame, block: int = 3, c: int = 2, v: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Blur each channel, turn gray, threshold adaptively."""
    blurred = gaussian_blur(df, v, keys, ("b", "g", "r"))
    return adaptive_threshold(to_gray(blurred), block, c, keys)
