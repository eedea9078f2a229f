"""Configured chains of image modules, and the hand-over to a text recogniser.

A module maps an image column to an image column; one made by ``from_kernel`` maps arrays, and such modules in a row run
in one call. What a failing module does to the rest of its chain is carried in the row (``image``, ``used``, ``error``),
so one bad image never stops a job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from glyphray.functions.text import is_blank, strip
from glyphray.operators import packed

NO_MODULES = "Geen modules gebruikt"  # fixed value: report text for an empty chain
# Why a module is not run.
UNREADABLE = "image could not be loaded"
DAMAGED = "damaged image"
NOT_COLOUR = "three channels expected"


@dataclass(frozen=True)
class Module:
    """``process`` may be None (the module is skipped); ``check`` gives an error text or null."""

    name: str
    process: Callable[[Column], Column] | None
    check: Callable[[Column], Column] | None = None
    enabled: bool = True
    params: dict = field(default_factory=dict)
    kernel: Callable[..., np.ndarray | None] | None = None
    colour: bool = False

    def with_params(self, **params) -> Module:
        return replace(self, params={**self.params, **params})


def _readable(img: Column) -> Column:
    """Null for an image whose bytes are all there."""
    fits = F.octet_length(img["data"]) == img["height"].cast("long") * img["width"] * img["channels"]
    return F.when(img.isNull(), UNREADABLE).when(~F.coalesce(fits, F.lit(False)), DAMAGED)


def _colour(img: Column) -> Column:
    return F.coalesce(_readable(img), F.when(img["channels"] != 3, NOT_COLOUR))


def from_kernel(name: str, kernel: Callable[..., np.ndarray | None], colour: bool = True) -> Module:
    """A module out of ``kernel(stack, **params)``, where ``stack`` is ``(images, height, width, channels)`` bytes.

    It gives the new stack, or None for no image. With ``colour`` it wants three channels.
    """
    process = lambda im, **params: packed.lift(partial(kernel, **params))(im)
    return Module(name, process, _colour if colour else _readable, kernel=kernel, colour=colour)


# Module names as configurations list them. One of them has no process and is skipped.
REGISTRY: dict[str, Module] = {
    m.name: m
    for m in (
        from_kernel("convert_black_white", lambda a, level=127: packed.above(packed.gray_of(a), level)),
        from_kernel("Medianblur", lambda a, k=3: packed.median_of(packed.gray_of(a), k)),
        from_kernel("upscaling", lambda a, scale_factor=2: packed.cubic_of(a, scale_factor)),
        # a chosen box as a colour image; an empty choice gives no image
        from_kernel("select_region", lambda a, box=(0, 0, 0, 0): packed.box_of(a, box[0], box[1], box[0] + box[2], box[1] + box[3]), False),
        from_kernel("tuned_filter", lambda a, block=3, c=2, v=1: packed.adaptive_of(packed.gray_of(packed.gaussian_of(a, v)), block, c)),
        Module("adaptive_threshold", None),
    )
}


def split_names(enabled: Column) -> Column:
    """Comma list of the configuration to an ordered array of trimmed names."""
    return F.transform(F.split(enabled, ",", -1), strip)


def load_order(names: Iterable[str], registry: dict[str, Module] = REGISTRY) -> tuple[list[Module], list[str]]:
    """Enabled modules in configured order, and the names that are missing or switched off."""
    found, dropped = [], []
    for name in (n.strip() for n in names):
        module = registry.get(name)
        if module is not None and module.enabled:
            found.append(module)
        else:
            dropped.append(name)
    return found, dropped


_DONE = pa.struct([("image", packed.ARROW), ("used", pa.list_(pa.string())), ("error", pa.string())])


def _problem(pixels: np.ndarray | None, colour: bool) -> str | None:
    """What ``_readable`` and ``_colour`` say, of pixels."""
    if pixels is None:
        return UNREADABLE
    if not pixels.size:
        return DAMAGED
    return NOT_COLOUR if colour and pixels.shape[-1] != 3 else None


def _attempt(module: Module, images: list[np.ndarray]) -> list[np.ndarray | str | None]:
    """What a module makes of equally shaped images; where it fails, the reason. One that fails takes no other along."""
    try:
        done = module.kernel(np.stack(images), **module.params)
        return [None] * len(images) if done is None else list(np.ascontiguousarray(done, dtype=np.uint8))
    except Exception as e:
        if len(images) > 1:
            return [result for image in images for result in _attempt(module, [image])]
        return [str(e) or type(e).__name__]


def _run_all(modules: Sequence[Module], current: pa.Array, original: pa.Array, stopped: pa.Array | None) -> pa.Array:
    """All modules on a batch, without leaving Python in between; images of one shape are worked on together."""
    now = packed.pixels(current)
    begin = now if original is current else packed.pixels(original)
    now, used = list(now), [[] for _ in now]
    error = [None] * len(now) if stopped is None else stopped.to_pylist()
    for module in modules:
        same: dict[tuple, list[int]] = {}
        sources = [b if n is None else n for n, b in zip(now, begin)]
        for i in [i for i, e in enumerate(error) if e is None]:
            error[i] = _problem(sources[i], module.colour)
            if error[i] is None:
                same.setdefault(sources[i].shape, []).append(i)
        for shape, at in same.items():
            step = max(1, packed.STACK_BYTES // math.prod(shape))
            for part in (at[k : k + step] for k in range(0, len(at), step)):
                for i, result in zip(part, _attempt(module, [sources[i] for i in part])):
                    if isinstance(result, str):
                        error[i] = result
                    else:
                        now[i] = result
                        used[i].append(module.name)
    images = packed.to_arrow([n if u else None for n, u in zip(now, used)])
    fields = [images, pa.array(used, _DONE.field("used").type), pa.array(error, pa.string())]
    return pa.StructArray.from_arrays(fields, fields=list(_DONE))


def _together(df: DataFrame, modules: Sequence[Module], img: str, first: bool) -> DataFrame:
    """One call for several modules in a row. At the beginning of a chain an image is its own original."""

    def begin(images: pa.Array) -> pa.Array:
        return _run_all(modules, images, images, None)

    def go_on(images: pa.Array, originals: pa.Array, errors: pa.Array) -> pa.Array:
        return _run_all(modules, images, originals, errors)

    run = packed.once(F.arrow_udf(begin if first else go_on, from_arrow_type(_DONE)))
    done = run(F.col(img)) if first else run(F.col(img), F.col("__original"), F.col("error"))
    ran = F.size("__done.used") > 0
    return df.withColumn("__done", done).withColumns(
        {
            img: F.when(ran, F.col("__done.image")).otherwise(F.col(img)),
            "used": F.concat("used", "__done.used"),
            "error": F.coalesce("error", "__done.error"),
        }
    ).drop("__done")


def apply_chain(images: DataFrame, modules: Sequence[Module], img: str = "image") -> DataFrame:
    """Fold the modules over ``img``; adds ``used array<string>`` and ``error string``.

    The first error, of a check or of the module itself, stops the chain of that image and keeps its partial result.
    A module that yields no image without failing makes the next one start again from the original. Modules in a row that
    have kernels go through Python once, all others once each.
    """
    state = images.withColumns(
        {
            "__original": F.col(img),
            "used": F.array().cast("array<string>"),
            "error": F.lit(None).cast("string"),
        }
    )

    def step(df: DataFrame, module: Module) -> DataFrame:
        source = F.coalesce(F.col(img), F.col("__original"))
        failure = module.check(source) if module.check else F.lit(None).cast("string")
        df = df.withColumn("__fail", F.when(F.col("error").isNull(), failure))
        runs = F.col("error").isNull() & F.col("__fail").isNull()
        df = df.withColumn("__done", module.process(F.when(runs, source), **module.params))
        broken = packed.failure(F.col("__done"))
        went = runs & broken.isNull()
        return df.withColumns(
            {
                img: F.when(went, F.col("__done")).otherwise(F.col(img)),
                "used": F.when(went, F.array_append("used", F.lit(module.name))).otherwise(F.col("used")),
                "error": F.coalesce("error", "__fail", broken),
            }
        ).drop("__fail", "__done")

    begun = False
    for arrays, run in groupby((m for m in modules if m.process is not None), lambda m: m.kernel is not None):
        state = _together(state, list(run), img, not begun) if arrays else reduce(step, run, state)
        begun = True
    return state.drop("__original")


def processed_or_original(images: DataFrame, modules: Sequence[Module], img: str = "image") -> DataFrame:
    """With no modules the recogniser sees the original image and nothing is reported as used."""
    if modules:
        return apply_chain(images, modules, img)
    return images.withColumns(
        {"used": F.array().cast("array<string>"), "error": F.lit(None).cast("string")}
    )


def used_modules_text(used: Column) -> Column:
    return F.when(F.size(used) > 0, F.array_join(used, ", ")).otherwise(NO_MODULES)


OCR_LINES = "array<struct<line_no:int,text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>"
_OCR = pa.struct(
    [
        ("lines", pa.list_(pa.struct(
            [("line_no", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())]
            + [(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]
        ))),
        ("ocr_error", pa.string()),
    ]
)


def _line(n: int, box, text: str, confidence: float) -> dict:
    xs, ys = [int(p[0]) for p in box], [int(p[1]) for p in box]
    return {
        "line_no": n, "text": text, "confidence": float(confidence),
        "x1": min(xs), "y1": min(ys), "x2": max(xs), "y2": max(ys),
    }


def recognize(images: DataFrame, make_reader: Callable[[], Callable], img: str = "image") -> DataFrame:
    """Text lines per image from a user-supplied reader; a failing image becomes an ``ocr_error``.

    ``make_reader`` runs once per task, not per image. The reader takes a ``(height, width,
    channels)`` byte array and yields ``(corner points, text, confidence)``. Adds ``lines`` and
    ``ocr_error``.
    """

    def read(batches):
        reader = None
        for batch in batches:
            out = []
            for im in batch:
                try:
                    reader = reader or make_reader()
                    if not im.is_valid:
                        raise ValueError(UNREADABLE)
                    shape = [im[f].as_py() for f in ("height", "width", "channels")]
                    found = reader(np.frombuffer(im["data"].as_buffer(), np.uint8).reshape(shape))
                    out.append({"lines": [_line(n, *f) for n, f in enumerate(found)], "ocr_error": None})
                except Exception as e:  # the row carries the failure
                    out.append({"lines": [], "ocr_error": str(e)})
            yield pa.array(out, _OCR)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = packed.once(F.arrow_udf(read, f"struct<lines:{OCR_LINES},ocr_error:string>"))
    return images.withColumn("__ocr", udf(F.col(img))).select("*", "__ocr.*").drop("__ocr")


def text_lines(read: DataFrame, key: str = "image_id") -> DataFrame:
    """Recognised lines as rows, blank ones dropped, text untrimmed."""
    rows = read.select(key, F.inline("lines"))
    return rows.filter(~is_blank(F.col("text")))
