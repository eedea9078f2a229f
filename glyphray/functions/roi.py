"""Regions of interest: parsing, validation and corner arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphray.functions.text import strip, to_int
from glyphray.session import bind

WRONG_COUNT = "wrong number of coordinates"
NOT_PARSED = "not a label with integer coordinates"


def parse_roi(raw: Column) -> Column:
    """``label:left,top,right,bottom`` to a struct; ``reason`` is null exactly for good values."""

    def numbers(parts: Column) -> Column:
        return F.struct(
            parts.alias("parts"), F.transform(F.split(strip(F.get(parts, 1)), ",", -1), to_int).alias("coords")
        )

    def checked(read: Column) -> Column:
        parts, coords = read["parts"], read["coords"]
        failed = F.coalesce((F.size(parts) != 2) | F.exists(coords, lambda c: c.isNull()), F.lit(True))
        reason = F.when(failed, NOT_PARSED).when(F.size(coords) != 4, WRONG_COUNT)
        return F.struct(parts.alias("parts"), coords.alias("coords"), reason.alias("reason"))

    def record(read: Column) -> Column:
        good = read["reason"].isNull()
        corners = [
            F.when(good, F.get(read["coords"], i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))
        ]
        label = F.when(good, strip(F.get(read["parts"], 0))).alias("label")
        return F.struct(label, *corners, read["reason"].alias("reason"))

    return bind(bind(bind(F.split(raw, ":", -1), numbers), checked), record)


def valid_roi(label: Column, coords: list[Column]) -> Column:
    """Accepted by the edit form: non-blank label and four integers (order is not checked)."""
    ok = F.length(strip(label)) > 0
    for c in coords:
        ok = ok & to_int(c).isNotNull()
    return F.coalesce(ok, F.lit(False))


def to_image(ax: Column, ay: Column, bx: Column, by: Column, zoom: Column) -> Column:
    """Two screen corners to an image box: undo the zoom, order the corners, truncate."""
    cut = lambda c: c.cast("int")
    ax, ay, bx, by = ax / zoom, ay / zoom, bx / zoom, by / zoom
    return F.struct(
        cut(F.least(ax, bx)).alias("x1"),
        cut(F.least(ay, by)).alias("y1"),
        cut(F.greatest(ax, bx)).alias("x2"),
        cut(F.greatest(ay, by)).alias("y2"),
    )


def to_screen(x: Column, y: Column, zoom: Column) -> Column:
    return F.struct((x * zoom).cast("int").alias("sx"), (y * zoom).cast("int").alias("sy"))


def rect_xywh(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Corner pair to origin and size; null when nothing was selected."""
    w, h = F.abs(bx - ax), F.abs(by - ay)
    box = F.struct(
        F.least(ax, bx).alias("x"), F.least(ay, by).alias("y"), w.alias("w"), h.alias("h")
    )
    return F.when((w != 0) & (h != 0), box)


def render_roi(label: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.concat(label, F.lit(":"), F.concat_ws(",", x1, y1, x2, y2))
