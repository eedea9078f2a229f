"""Whole images (or bands of them) as one row: ``struct<height, width, channels, data>``.

``data`` holds one byte per channel, line after line, channels interleaved (blue first). This is the
form images arrive in and the one to use at volume: a neighbourhood needs no shuffle, because the row
already holds the neighbours. Cropping is byte slicing in the JVM; the numeric kernels are a few
lines of array code run on Arrow batches. ``split_bands`` cuts giant images into independent rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphray.operators.pixels import gaussian_weights, odd_kernel
from glyphray.session import bind

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
ARROW = pa.struct(
    [("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]
)


def image(height, width, channels, data) -> Column:
    return F.struct(
        height.cast("int").alias("height"),
        width.cast("int").alias("width"),
        channels.cast("int").alias("channels"),
        data.alias("data"),
    )


# --- kernels: (..., height, width, channels) uint8 -> array of the same kind ---------------------

Y, X, C = -3, -2, -1
STACK_BYTES = 1 << 18  # images of one shape are worked on together up to this size; kernels hold many times as much
COUNT_BYTES = 1 << 22  # histograms of medians that are held at a time


def _axis_sum(a: np.ndarray, weights: list[int], axis: int, mode: str) -> np.ndarray:
    r = len(weights) // 2
    n = a.shape[axis]
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    wide = np.pad(a, pad, mode=mode)
    total = np.zeros_like(a)
    at = [slice(None)] * a.ndim
    for i, w in enumerate(weights):
        at[axis] = slice(i, i + n)
        total += w * wide[tuple(at)]
    return total


def gray_of(a):
    b, g, r = (a[..., i].astype(np.int64) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000)[..., None].astype(np.uint8)


def adaptive_of(a, block, c):
    k = block | 1
    a = a.astype(np.int64)
    s = a
    for axis in (Y, X):
        s = _axis_sum(s, [1] * k, axis, "edge")
    mean = (2 * s + k * k) // (2 * k * k)
    return np.where(a > mean - c, 255, 0)


def gaussian_of(a, v):
    s = a.astype(np.int64)
    for axis in (Y, X):
        s = _axis_sum(s, gaussian_weights(v), axis, "reflect" if s.shape[axis] > 1 else "edge")
    return (s + (1 << 31)) >> 32


WIDEST_SORTED = 7  # windows up to this size are sorted, larger ones counted
STRIP = 1024  # columns whose histograms are held at a time


def median_of(a, k):
    k = odd_kernel(k)
    if k > WIDEST_SORTED:
        return _counted_median(a, k)
    r = k // 2
    pad = [(0, 0)] * a.ndim
    pad[Y] = pad[X] = (r, r)
    wide = np.pad(a, pad, mode="edge")
    out = np.empty_like(a)
    for y in range(a.shape[Y]):  # one line at a time bounds memory
        near = np.lib.stride_tricks.sliding_window_view(wide[..., y : y + k, :, :], (k, k), axis=(Y, X))[..., 0, :, :, :, :]
        flat = near.reshape(*near.shape[:-2], k * k)
        out[..., y, :, :] = np.partition(flat, k * k // 2, axis=-1)[..., k * k // 2]
    return out


def above(a, level):
    return np.where(a > level, 255, 0)


def box_of(a, x1, y1, x2, y2):
    """A box clipped to the image, in colour; None when nothing is left."""
    cut = a[..., max(y1, 0):max(y2, 0), max(x1, 0):max(x2, 0), :]
    if 0 in cut.shape:
        return None
    return np.repeat(cut, 3, axis=C) if cut.shape[C] == 1 else cut


def _counted_median(a, k):
    """As ``median_of``, from a histogram per column that slides down the image: a pixel costs the same for every ``k``."""
    planes = np.moveaxis(a, C, Y).reshape(-1, *a.shape[Y:C])
    r, width = k // 2, a.shape[X]
    wide = np.pad(planes, ((0, 0), (r, r), (r, r)), mode="edge")
    out = np.empty_like(planes)
    for left in range(0, width, STRIP):
        right = min(left + STRIP, width)
        step = max(1, COUNT_BYTES // (1024 * (right - left + k)))  # four bytes for each of 256 values
        for n in range(0, len(planes), step):
            out[n : n + step, :, left:right] = _sliding_median(wide[n : n + step, :, left : right + 2 * r], k)
    channels_first = out.reshape(*a.shape[:Y], a.shape[C], *a.shape[Y:C])
    return np.moveaxis(channels_first, Y, C)


def _sliding_median(wide: np.ndarray, k: int) -> np.ndarray:
    """Medians of all windows inside ``(planes, height, width)``.

    Differences of running sums over columns are the histograms of windows. The sixteen coarse counts of a window tell
    where its median is, and only the sixteen values there are looked at.
    """
    planes, height, columns = wide.shape[0], wide.shape[1] - k + 1, wide.shape[2]
    width = columns - k + 1
    plane, column = np.ogrid[:planes, :columns]
    fine, coarse = (np.zeros((planes, values, columns), np.int32) for values in (256, 16))
    fine_sums, coarse_sums = (np.zeros((planes, values, columns + 1), np.int32) for values in (256, 16))
    by_block = fine_sums.reshape(planes, 16, 16, columns + 1)

    def count(line: int, by: int) -> None:
        fine[plane, wide[:, line], column] += by
        coarse[plane, wide[:, line] >> 4, column] += by

    for line in range(k - 1):
        count(line, 1)
    out = np.empty((planes, height, width), np.uint8)
    starts, middle = column[:, :width], k * k // 2 + 1
    for y in range(height):
        count(y + k - 1, 1)
        np.cumsum(coarse, axis=2, out=coarse_sums[..., 1:])
        np.cumsum(fine, axis=2, out=fine_sums[..., 1:])
        up_to = np.cumsum(coarse_sums[..., k:] - coarse_sums[..., :width], axis=1)
        before = up_to < middle
        block = before.sum(axis=1)
        left = middle - np.max(up_to * before, axis=1)
        inside = np.cumsum(by_block[plane, block, :, starts + k] - by_block[plane, block, :, starts], axis=-1)
        out[:, y] = 16 * block + (inside < left[..., None]).sum(axis=-1)
        count(y, -1)
    return out


def _cubic_axis(a, factor, axis):
    n = a.shape[axis]
    out = np.arange(int(n * factor))
    src = (out + 0.5) / factor - 0.5
    base = np.floor(src).astype(np.int64)
    t, cubic = src - base, -0.75
    near = lambda d: ((cubic + 2) * d - (cubic + 3)) * d * d + 1
    far = lambda d: ((cubic * d - 5 * cubic) * d + 8 * cubic) * d - 4 * cubic
    w = [np.floor(f * 256 + 0.5).astype(np.int64) for f in (far(t + 1), near(1 - t), far(2 - t))]
    w.insert(1, 256 - w[0] - w[1] - w[2])
    shape = [1] * a.ndim
    shape[axis] = len(out)
    return sum(
        w[i].reshape(shape) * np.take(a, np.clip(base - 1 + i, 0, n - 1), axis=axis) for i in range(4)
    )


def cubic_of(a, factor):
    s = _cubic_axis(_cubic_axis(a.astype(np.int64), factor, X), factor, Y)
    return np.clip((s + (1 << 15)) >> 16, 0, 255)


def once(udf):
    """Keep the optimizer from evaluating a costly function twice.

    Exploding a function's result makes Spark infer a filter on that result and push it, function
    included, down to the scan; marked as non-deterministic the function stays in one place.
    """
    return udf.asNondeterministic()


def _stacks(images: pa.Array, channels: int | None):
    """Positions and pixels of equally shaped images, a bounded number at a time.

    Rows without image, or whose bytes do not fit their size, are left out.
    """
    sizes = [images.field(f).to_pylist() for f in ("height", "width", "channels")]
    data = images.field("data")
    valid, lengths = images.is_valid().to_pylist(), pc.binary_length(data).to_pylist()
    same: dict[tuple, list[int]] = {}
    for i, shape in enumerate(zip(*sizes)):
        fits = valid[i] and None not in shape and lengths[i] == math.prod(shape) > 0
        if fits and (channels is None or shape[2] == channels):
            same.setdefault(shape, []).append(i)
    for shape, at in same.items():
        step = max(1, STACK_BYTES // math.prod(shape))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            joined = b"".join(data[i].as_buffer() for i in part)
            yield part, np.frombuffer(joined, np.uint8).reshape(len(part), *shape)


def pixels(images: pa.Array) -> list[np.ndarray | None]:
    """Pixels of each image: None for no image, nothing (size 0) where the bytes do not fit the size."""
    sizes = zip(*(images.field(f).to_pylist() for f in ("height", "width", "channels")))
    out: list[np.ndarray | None] = []
    for valid, shape, data in zip(images.is_valid().to_pylist(), sizes, images.field("data")):
        flat = np.frombuffer(data.as_buffer(), np.uint8) if valid and data.is_valid else np.empty(0, np.uint8)
        fits = None not in shape and flat.size == math.prod(shape)
        out.append((flat.reshape(shape) if fits else flat[:0]) if valid else None)
    return out


def to_arrow(images: list[np.ndarray | None]) -> pa.Array:
    sizes = [(None,) * 3 if a is None else a.shape for a in images]
    fields = [pa.array([s[i] for s in sizes], pa.int32()) for i in range(3)]
    fields.append(pa.array([None if a is None else a.tobytes() for a in images], pa.binary()))
    return pa.StructArray.from_arrays(fields, fields=list(ARROW), mask=pa.array([a is None for a in images], pa.bool_()))


def lift(kernel, channels: int | None = None):
    """Arrow scalar function around a kernel; null for null, wrong channel count or damaged images.

    Images on which the kernel fails become ``failure`` values, and these pass through later kernels.
    """

    def run(images: pa.Array) -> pa.Array:
        out = [None] * len(images)
        for i in np.flatnonzero(images.field("height").is_null().to_numpy(zero_copy_only=False)):
            image = images[i].as_py()
            if image and [k for k, v in image.items() if v is not None] == ["data"]:
                out[i] = image
        for at, stack in _stacks(images, channels):
            try:
                done = kernel(stack)
                if done is None:  # a kernel may choose to give no image
                    continue
                done = np.ascontiguousarray(done, dtype=np.uint8)
            except Exception as e:  # these images say why, the others of the batch go on
                text = (str(e) or type(e).__name__).encode()
                for i in at:
                    out[i] = {"height": None, "width": None, "channels": None, "data": text}
                continue
            height, width, depth = done.shape[1:]
            for i, a in zip(at, done):
                out[i] = {"height": height, "width": width, "channels": depth, "data": a.tobytes()}
        return pa.array(out, ARROW)

    run.__annotations__ = {"images": pa.Array, "return": pa.Array}
    return once(F.arrow_udf(run, IMAGE))


def failure(img: Column) -> Column:
    """Why a kernel gave no image; null for an image and for none. Such a value has no size, and the reason as its bytes."""
    size = F.coalesce(img["height"], img["width"], img["channels"])
    return F.when(size.isNull(), F.decode(img["data"], "UTF-8"))


def to_gray(img: Column) -> Column:
    return lift(gray_of, 3)(img)


def to_rgb(img: Column) -> Column:
    return lift(lambda a: np.repeat(a, 3, axis=C), 1)(img)


def interleave(img: Column) -> Column:
    """Channel-after-channel bytes to one pixel after another."""

    def kernel(a):
        n, height, width, depth = a.shape
        return a.reshape(n, depth, height, width).transpose(0, 2, 3, 1)

    return lift(kernel, 3)(img)


def flip_channels(img: Column) -> Column:
    """Blue-first to red-first or back."""
    return lift(lambda a: a[..., ::-1], 3)(img)


def threshold(img: Column, level: int = 127) -> Column:
    return lift(lambda a: above(a, level))(img)


def adaptive_threshold(img: Column, block: int = 3, c: int = 2) -> Column:
    return lift(lambda a: adaptive_of(a, block, c))(img)


def gaussian_blur(img: Column, v: int = 1) -> Column:
    return lift(lambda a: gaussian_of(a, v))(img)


def median_blur(img: Column, k: int = 3) -> Column:
    return lift(lambda a: median_of(a, k))(img)


def upscale(img: Column, factor: float = 2) -> Column:
    return lift(lambda a: cubic_of(a, factor))(img)


def select_box(img: Column, x1: int, y1: int, x2: int, y2: int) -> Column:
    """A fixed box, clipped to the image, as a colour image; null when nothing is left."""
    return lift(lambda a: box_of(a, x1, y1, x2, y2))(img)


def tuned_filter(img: Column, block: int = 3, c: int = 2, v: int = 1) -> Column:
    return adaptive_threshold(to_gray(gaussian_blur(img, v)), block, c)


# --- JVM-side slicing -------------------------------------------------------------------------


def _lines(data: Column, first: Column, count: Column, stride: Column) -> Column:
    return F.substring(data, first * stride + 1, count * stride)


def crop(img: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Box clipped to the image, cut line by line in the JVM; null when nothing is left.

    The bytes are taken out of the row once and lines are cut from that. Byte strings are joined as text, which Spark
    moves without looking inside.
    """
    left, top = F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0))
    right, bottom = F.least(x2, img["width"]), F.least(y2, img["height"])
    ch = img["channels"]

    def lines(whole: Column) -> Column:
        part = lambda y: F.substring(
            whole["data"], (y * whole["width"] + whole["left"]) * whole["ch"] + 1, whole["size"]).cast("string")
        return F.array_join(F.transform(F.sequence(whole["top"], whole["bottom"] - 1), part), "").cast("binary")

    cut = F.struct(
        img["data"].alias("data"), img["width"].alias("width"), ch.alias("ch"), left.alias("left"), top.alias("top"),
        bottom.alias("bottom"), ((right - left) * ch).alias("size"),
    )
    data = bind(cut, lines)
    return F.when((left < right) & (top < bottom), image(bottom - top, right - left, ch, data))


def slices(frames: DataFrame, volume: str = "volume", count: str = "frames") -> DataFrame:
    """One row per frame, numbered from 1, cut from frame-major bytes; a null count keeps one row."""
    v = F.col(volume)
    size = v["height"] * v["width"] * v["channels"]
    shape = [v[f].alias(f) for f in ("height", "width", "channels")]
    whole = F.struct(v["data"].alias("data"), size.alias("size"), F.col(count).alias("count"), *shape)
    # all that a row needs comes out of the generator: the volume itself goes no further
    cut = bind(whole, lambda w: F.transform(
        F.sequence(F.lit(1), w["count"]),
        lambda i: F.struct(i.alias("slice_no"), image(
            w["height"], w["width"], w["channels"], F.substring(w["data"], (i - 1) * w["size"] + 1, w["size"])).alias("__part")),
    ))
    rest = [F.col(c) for c in frames.columns if c not in (volume, "slice_no")]
    return frames.select(*rest, F.inline_outer(cut)).select(
        *[F.col("__part").alias(volume) if c == volume else F.col(c) for c in frames.columns if c != "slice_no"], "slice_no"
    )


def split_bands(df: DataFrame, rows: int, halo: int, img: str = "image") -> DataFrame:
    """Cut images into bands of ``rows`` lines plus ``halo`` lines of context on either side.

    Bands are independent: any chain whose radii add up to at most ``halo`` may run on them, then
    ``trim_bands`` drops the context. Costs ``2 * halo / rows`` extra bytes and no exchange; follow
    with ``repartition("image_id", "band")`` where single images are giant.
    """
    i = F.col(img)
    whole = F.struct(
        i["data"].alias("data"), (i["width"] * i["channels"]).alias("stride"),
        *[i[f].alias(f) for f in ("height", "width", "channels")],
    )

    def band(w: Column, b: Column) -> Column:
        y0 = b * rows
        top = F.least(y0, F.lit(halo))
        taken = F.least(w["height"], y0 + rows + halo) - (y0 - top)
        return F.struct(
            b.alias("band"), y0.alias("y0"), top.alias("top"), F.least(w["height"] - y0, F.lit(rows)).alias("kept"),
            image(taken, w["width"], w["channels"], _lines(w["data"], y0 - top, taken, w["stride"])).alias("__part"),
        )

    cut = bind(whole, lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((w["height"] - 1) / rows).cast("int")), lambda b: band(w, b)
    ))
    rest = [c for c in df.columns if c != img]
    bands = df.select(*rest, F.inline_outer(cut))
    part = F.col("__part").alias(img)
    return bands.select(*[part if c == img else F.col(c) for c in df.columns], "band", "y0", "top", "kept")


def trim_bands(df: DataFrame, img: str = "image") -> DataFrame:
    i = F.col(img)
    stride = i["width"] * i["channels"]
    cut = image(F.col("kept"), i["width"], i["channels"], _lines(i["data"], F.col("top"), F.col("kept"), stride))
    return df.withColumn(img, cut).drop("top", "kept")


# --- between the two forms ---------------------------------------------------------------------


def _bytes_to_ints(data: pa.Array) -> pa.Array:
    out = [np.frombuffer(d.as_buffer(), np.uint8).astype(np.int32) if d.is_valid else None for d in data]
    return pa.array(out, pa.list_(pa.int32()))


bytes_to_ints = once(F.arrow_udf(_bytes_to_ints, T.ArrayType(T.IntegerType())))


def unpack(df: DataFrame, img: str = "image") -> DataFrame:
    """Packed gray or colour images to long rows ``(height, width, y, x, c, v)``.

    Images fall into lines first; from there on no row holds more than one line.
    """
    i = F.col(img)
    keep = [c for c in df.columns if c != img]
    stride = i["width"] * i["channels"]
    shape = [i[f].alias(f) for f in ("height", "width", "channels")]
    whole = F.struct(i["data"].alias("data"), stride.alias("stride"), *shape)
    # lines and sizes leave the image together, so neither it nor a copy goes with them to the array function
    cut = bind(whole, lambda w: F.transform(F.sequence(F.lit(0), w["height"] - 1), lambda y: F.struct(
        w["height"].alias("height"), w["width"].alias("width"), w["channels"].alias("channels"), y.alias("y"),
        F.substring(w["data"], y * w["stride"] + 1, w["stride"]).alias("__line"),
    )))
    lines = df.select(*keep, F.inline_outer(cut))
    head = [*keep, "height", "width", "channels", "y"]
    cells = lines.select(*head, bytes_to_ints(F.col("__line")).alias("__v")).select(
        *head, F.posexplode_outer("__v").alias("__i", "v")
    )
    channels = F.col("channels")
    return cells.select(
        *keep, "height", "width", "y",
        F.floor(F.col("__i") / channels).cast("int").alias("x"), (F.col("__i") % channels).cast("int").alias("c"), "v",
    )


def unpack_gray(df: DataFrame, img: str = "image") -> DataFrame:
    return unpack(df, img).drop("c").withColumnRenamed("v", "p")
