"""Views of the given tables as images, regions and files, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import table
from glyphray.operators import packed

SIDE = 8


def gray_levels(embedding: Column) -> Column:
    level = lambda v: F.floor((v.cast("double") + 0.5) * 255).cast("int")
    return F.transform(embedding, lambda v: F.least(F.greatest(level(v), F.lit(0)), F.lit(255)))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").repartition("vec_id").select(
        F.col("vec_id").alias("image_id"), "label",
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), gray_levels(F.col("embedding")).alias("v"),
    )


def gray_pixels(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    cell = lambda p, i: F.struct(
        F.floor(i / SIDE).cast("int").alias("y"), (i % SIDE).cast("int").alias("x"), p.alias("p")
    )
    return _images(spark, sf).select("image_id", *extra, "height", "width", F.inline_outer(F.transform("v", cell)))


def colour_pixels(spark: SparkSession, sf: str) -> DataFrame:
    n = SIDE * SIDE
    cell = lambda p, i: F.struct(
        F.floor(i / SIDE).cast("int").alias("y"), (i % SIDE).cast("int").alias("x"),
        p.alias("b"),
        F.get("v", ((i + 1) % n).cast("int")).alias("g"),
        F.get("v", ((i + 2) % n).cast("int")).alias("r"),
    )
    return _images(spark, sf).select("image_id", "height", "width", F.inline_outer(F.transform("v", cell)))


def as_bytes(levels: Column) -> Column:
    return F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def packed_gray(spark: SparkSession, sf: str) -> DataFrame:
    side = F.lit(SIDE)
    return _images(spark, sf).select(
        "image_id", "label", packed.image(side, side, F.lit(1), as_bytes(F.col("v"))).alias("image")
    )


def packed_colour(spark: SparkSession, sf: str) -> DataFrame:
    side, n = F.lit(SIDE), SIDE * SIDE
    at = lambda i, k: F.get("v", ((i + k) % n).cast("int"))
    bgr = F.flatten(F.transform("v", lambda p, i: F.array(p, at(i, 1), at(i, 2))))
    return _images(spark, sf).select(
        "image_id", "label", packed.image(side, side, F.lit(3), as_bytes(bgr)).alias("image")
    )


def nation_rois(spark: SparkSession, sf: str) -> DataFrame:
    """Small boxes, some reaching out of the image, some empty or inverted."""
    n = F.col("n_nationkey")
    x1, y1 = n % 7 - 1, n % 5 - 1
    return table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("config"), n.alias("ord"), F.col("n_name").alias("label"),
        x1.alias("x1"), y1.alias("y1"), (x1 + n % 6).alias("x2"), (y1 + 5 - n % 7).alias("y2"),
    )


# --- the same in SQL ---------------------------------------------------------------------------

_LEVEL = "CAST(least(greatest(floor((CAST(embedding[{i} + 1] AS DOUBLE) + 0.5) * 255), 0), 255) AS INTEGER)"
PX = f"""px AS (
  SELECT vec_id AS image_id, label, 8 AS height, 8 AS width,
         CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {_LEVEL.format(i='i')} AS p
  FROM embeddings, range(64) t(i))"""
CPX = f"""cpx AS (
  SELECT vec_id AS image_id, label, 8 AS height, 8 AS width,
         CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
         {_LEVEL.format(i='i')} AS b, {_LEVEL.format(i='(i + 1) % 64')} AS g, {_LEVEL.format(i='(i + 2) % 64')} AS r
  FROM embeddings, range(64) t(i))"""
ROIS = """rois AS (
  SELECT n_regionkey AS config, n_nationkey AS ord, n_name AS label,
         n_nationkey % 7 - 1 AS x1, n_nationkey % 5 - 1 AS y1,
         n_nationkey % 7 - 1 + n_nationkey % 6 AS x2, n_nationkey % 5 - 1 + 5 - n_nationkey % 7 AS y2
  FROM nation)"""
GRAY = "CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS INTEGER)"


def box_mean_sql(src: str, radius: int, out: str) -> str:
    """Brute force local mean over a replicated border."""
    n = (2 * radius + 1) ** 2
    return f"""{out} AS (
  SELECT a.image_id, a.height, a.width, a.y, a.x, any_value(a.p) AS p,
         CAST((2 * sum(b.p) + {n}) // {2 * n} AS INTEGER) AS mean
  FROM {src} a, range(-{radius}, {radius + 1}) dy(j), range(-{radius}, {radius + 1}) dx(i), {src} b
  WHERE b.image_id = a.image_id
    AND b.y = least(greatest(a.y + j, 0), a.height - 1) AND b.x = least(greatest(a.x + i, 0), a.width - 1)
  GROUP BY a.image_id, a.height, a.width, a.y, a.x)"""


def gaussian_sql(src: str, v: int, cols: str, out: str) -> str:
    """Brute force blur over a mirrored 8 x 8 image, weights worked out in SQL."""
    names = [c.strip() for c in cols.split(",")]
    sums = ", ".join(f"sum(CAST(w AS BIGINT) * {{t}}.{c}) AS {c}" for c in names)
    return f"""raw_w AS (
  SELECT i, exp(-(i * i) / (2 * pow(0.3 * ({v} - 1) + 0.8, 2))) AS e FROM range(-{v}, {v + 1}) t(i)),
rounded_w AS (SELECT i, CAST(floor(65536 * e / (SELECT sum(e) FROM raw_w) + 0.5) AS BIGINT) AS w FROM raw_w),
weights AS (
  SELECT i, w + CASE WHEN i = 0 THEN 65536 - (SELECT sum(w) FROM rounded_w) ELSE 0 END AS w FROM rounded_w),
taps AS (
  SELECT d, least(((d + i) % 14 + 14) % 14, 14 - ((d + i) % 14 + 14) % 14) AS s, CAST(sum(w) AS BIGINT) AS w
  FROM range(0, 8) o(d), weights GROUP BY ALL),
blur_x AS (
  SELECT image_id, height, width, y, CAST(d AS INTEGER) AS x, {sums.format(t='q')}
  FROM {src} q JOIN taps ON q.x = taps.s GROUP BY image_id, height, width, y, d),
{out} AS (
  SELECT image_id, height, width, CAST(d AS INTEGER) AS y, x,
         {', '.join(f'CAST((sum(CAST(w AS BIGINT) * q.{c}) + 2147483648) // 4294967296 AS INTEGER) AS {c}' for c in names)}
  FROM blur_x q JOIN taps ON q.y = taps.s GROUP BY image_id, height, width, d, x)"""
