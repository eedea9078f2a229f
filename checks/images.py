"""Image operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    CPX, GRAY, PX, ROIS, as_bytes, box_mean_sql, colour_pixels, gaussian_sql, gray_levels,
    gray_pixels, nation_rois, packed_colour, packed_gray,
)
from checks.registry import query, table
from glyphray.functions.names import slice_name
from glyphray.operators import crop, packed, pixels

CELL = ["image_id", "y", "x"]


@query("image_slices", f"""
SELECT vec_id AS image_id, CAST(i // 16 + 1 AS INTEGER) AS slice_no,
       vec_id || '_slice_' || (i // 16 + 1) || '.jpg' AS image_name,
       CAST(i % 16 // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x,
       CAST(least(greatest(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255), 0), 255) AS INTEGER) AS p
FROM embeddings, range(64) t(i)""")
def image_slices(spark, sf):
    four = F.lit(4)
    volumes = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), four.alias("frames"),
        packed.image(four, four, F.lit(1), as_bytes(gray_levels(F.col("embedding")))).alias("volume"),
    )
    cut = packed.slices(volumes).withColumn("image_name", slice_name(F.col("image_id").cast("string"), F.col("slice_no")))
    return packed.unpack_gray(cut, "volume").select("image_id", "slice_no", "image_name", "y", "x", "p")


@query("image_to_rgb", f"WITH {PX} SELECT image_id, y, x, p AS b, p AS g, p AS r FROM px")
def image_to_rgb(spark, sf):
    return pixels.to_rgb(gray_pixels(spark, sf)).select(*CELL, "b", "g", "r")


@query("image_to_gray", f"WITH {CPX} SELECT image_id, y, x, {GRAY} AS p FROM cpx")
def image_to_gray(spark, sf):
    return pixels.to_gray(colour_pixels(spark, sf)).select(*CELL, "p")


@query("image_swap_channels", f"WITH {CPX} SELECT image_id, y, x, r AS b, g, b AS r FROM cpx")
def image_swap_channels(spark, sf):
    return pixels.swap_channels(colour_pixels(spark, sf)).select(*CELL, "b", "g", "r")


@query("image_threshold", f"WITH {PX} SELECT image_id, y, x, CASE WHEN p > 127 THEN 255 ELSE 0 END AS p FROM px")
def image_threshold(spark, sf):
    return pixels.threshold(gray_pixels(spark, sf)).select(*CELL, "p")


@query("image_box_mean", f"WITH {PX}, {box_mean_sql('px', 2, 'm')} SELECT image_id, y, x, mean FROM m")
def image_box_mean(spark, sf):
    return pixels.box_mean(gray_pixels(spark, sf), 2).select(*CELL, "mean")


_ADAPTIVE = """WITH {px}, {m} SELECT image_id, y, x, CASE WHEN p > mean - {c} THEN 255 ELSE 0 END AS p FROM m"""


@query("image_adaptive_threshold", _ADAPTIVE.format(px=PX, m=box_mean_sql("px", 1, "m"), c=2))
def image_adaptive_threshold(spark, sf):
    return pixels.adaptive_threshold(gray_pixels(spark, sf), 3, 2).select(*CELL, "p")


@query("image_adaptive_threshold_wide", _ADAPTIVE.format(px=PX, m=box_mean_sql("px", 4, "m"), c=5))
def image_adaptive_threshold_wide(spark, sf):
    """An even block size grows to the next odd one."""
    return pixels.adaptive_threshold(gray_pixels(spark, sf), 8, 5).select(*CELL, "p")


@query("image_adaptive_threshold_packed", _ADAPTIVE.format(px=PX, m=box_mean_sql("px", 1, "m"), c=2))
def image_adaptive_threshold_packed(spark, sf):
    done = packed_gray(spark, sf).select("image_id", packed.adaptive_threshold(F.col("image"), 3, 2).alias("image"))
    return packed.unpack_gray(done).select(*CELL, "p")


_BLUR = "WITH {px}, {g} SELECT image_id, y, x, p FROM blurred"


@query("image_gaussian_blur", _BLUR.format(px=PX, g=gaussian_sql("px", 1, "p", "blurred")))
def image_gaussian_blur(spark, sf):
    return pixels.gaussian_blur(gray_pixels(spark, sf), 1).select(*CELL, "p")


@query("image_gaussian_blur_wide", _BLUR.format(px=PX, g=gaussian_sql("px", 15, "p", "blurred")))
def image_gaussian_blur_wide(spark, sf):
    """Largest setting: the kernel exceeds the image, so the border is mirrored repeatedly."""
    return pixels.gaussian_blur(gray_pixels(spark, sf), 15).select(*CELL, "p")


@query("image_gaussian_blur_packed", _BLUR.format(px=PX, g=gaussian_sql("px", 15, "p", "blurred")))
def image_gaussian_blur_packed(spark, sf):
    done = packed_gray(spark, sf).select("image_id", packed.gaussian_blur(F.col("image"), 15).alias("image"))
    return packed.unpack_gray(done).select(*CELL, "p")


def _median_sql(k: int) -> str:
    r = k // 2
    return f"""WITH {PX}
SELECT a.image_id, a.y, a.x, list_sort(list(b.p))[{k * k // 2 + 1}] AS p
FROM px a, range(-{r}, {r + 1}) dy(j), range(-{r}, {r + 1}) dx(i), px b
WHERE b.image_id = a.image_id AND b.y = least(greatest(a.y + j, 0), 7) AND b.x = least(greatest(a.x + i, 0), 7)
GROUP BY a.image_id, a.y, a.x"""


@query("image_median_blur", _median_sql(3))
def image_median_blur(spark, sf):
    return pixels.median_blur(gray_pixels(spark, sf), 3).select(*CELL, "p")


@query("image_median_blur_wide", _median_sql(9))
def image_median_blur_wide(spark, sf):
    """An even kernel grows to the next odd one."""
    return pixels.median_blur(gray_pixels(spark, sf), 8).select(*CELL, "p")


@query("image_median_blur_packed", _median_sql(9))
def image_median_blur_packed(spark, sf):
    done = packed_gray(spark, sf).select("image_id", packed.median_blur(F.col("image"), 9).alias("image"))
    return packed.unpack_gray(done).select(*CELL, "p")


@query("image_median_blur_large", _median_sql(49))
def image_median_blur_large(spark, sf):
    """The largest window of the configuration."""
    done = packed_gray(spark, sf).select("image_id", packed.median_blur(F.col("image"), 49).alias("image"))
    return packed.unpack_gray(done).select(*CELL, "p")


_UPSCALE = f"""WITH {PX},
taps AS (
  SELECT CAST(d AS INTEGER) AS d, least(greatest(CAST(floor((d + 0.5) / 2 - 0.5) AS INTEGER) - 1 + k, 0), 7) AS s,
         CASE WHEN d % 2 = 1 THEN [-27, 225, 67, -9][k + 1] ELSE [-9, 67, 225, -27][k + 1] END AS w
  FROM range(0, 16) o(d), range(0, 4) t(k)),
wide AS (
  SELECT image_id, y, d AS x, CAST(sum(CAST(w AS BIGINT) * p) AS BIGINT) AS p
  FROM px JOIN taps ON px.x = taps.s GROUP BY image_id, y, d)
SELECT image_id, d AS y, x,
       CAST(least(greatest(floor((sum(CAST(w AS BIGINT) * p) + 32768) / 65536.0), 0), 255) AS INTEGER) AS p
FROM wide JOIN taps ON wide.y = taps.s GROUP BY image_id, d, x"""


@query("image_upscale", _UPSCALE)
def image_upscale(spark, sf):
    return pixels.upscale(gray_pixels(spark, sf), 2).select(*CELL, "p")


@query("image_upscale_packed", _UPSCALE)
def image_upscale_packed(spark, sf):
    done = packed_gray(spark, sf).select("image_id", packed.upscale(F.col("image"), 2).alias("image"))
    return packed.unpack_gray(done).select(*CELL, "p")


@query("image_fit_scale", """
WITH s AS (SELECT p_partkey, 100 + p_size * 37 AS w, 80 + CAST(p_partkey % 900 AS INTEGER) AS h FROM part),
f AS (SELECT *, least(1920.0::DOUBLE / w, 1080.0::DOUBLE / h) AS s FROM s),
g AS (SELECT *, CAST(trunc(w * s) AS INTEGER) AS fit_w, CAST(trunc(h * s) AS INTEGER) AS fit_h FROM f)
SELECT p_partkey, fit_w, fit_h, CAST(trunc(fit_w * 0.9::DOUBLE) AS INTEGER) AS small_w,
       CAST(trunc(fit_h * 0.9::DOUBLE) AS INTEGER) AS small_h FROM g""")
def image_fit_scale(spark, sf):
    w, h = F.lit(100) + F.col("p_size") * 37, F.lit(80) + (F.col("p_partkey") % 900).cast("int")
    fit, small = pixels.fit_scale(w, h, 1920, 1080), pixels.fit_scale(w, h, 1920, 1080, 0.9)
    return table(spark, sf, "part").select(
        "p_partkey", fit["fit_w"].alias("fit_w"), fit["fit_h"].alias("fit_h"),
        small["fit_w"].alias("small_w"), small["fit_h"].alias("small_h"),
    )


_TUNED = f"""WITH {CPX}, {gaussian_sql('cpx', 1, 'b, g, r', 'blurred')},
gray AS (SELECT image_id, height, width, y, x, {GRAY} AS p FROM blurred),
{box_mean_sql('gray', 1, 'm')}
SELECT image_id, y, x, CASE WHEN p > mean - 2 THEN 255 ELSE 0 END AS p FROM m"""


@query("image_tuned_filter", _TUNED)
def image_tuned_filter(spark, sf):
    return pixels.tuned_filter(colour_pixels(spark, sf), 3, 2, 1).select(*CELL, "p")


@query("image_tuned_filter_bands", _TUNED)
def image_tuned_filter_bands(spark, sf):
    """The same chain on three-line bands with two lines of context: no exchange of pixels."""
    bands = packed.split_bands(packed_colour(spark, sf).drop("label"), rows=3, halo=2)
    done = packed.trim_bands(bands.withColumn("image", packed.tuned_filter(F.col("image"), 3, 2, 1)))
    return packed.unpack_gray(done).select("image_id", (F.col("y") + F.col("y0")).alias("y"), "x", "p")


@query("crop_clip", f"""WITH {PX}, {ROIS}
SELECT px.image_id, rois.label, px.y - greatest(y1, 0) AS y, px.x - greatest(x1, 0) AS x,
       least(y2, 8) - greatest(y1, 0) AS height, least(x2, 8) - greatest(x1, 0) AS width, p
FROM px JOIN rois ON px.image_id % 5 = rois.config
WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2""")
def crop_clip(spark, sf):
    px = gray_pixels(spark, sf).withColumn("config", (F.col("image_id") % 5).cast("int"))
    cut = crop.crop_clip(px, nation_rois(spark, sf), ["config"])
    return cut.select("image_id", "label", "y", "x", "height", "width", "p")


@query("crop_pad", f"""WITH {PX}, {ROIS}
SELECT i.vec_id AS image_id, rois.label, CAST(cy.v AS INTEGER) AS y, CAST(cx.v AS INTEGER) AS x, coalesce(px.p, 0) AS p
FROM embeddings i, rois, range(0, 8) cy(v), range(0, 8) cx(v)
LEFT JOIN px ON px.image_id = i.vec_id AND px.y = cy.v + rois.y1 AND px.x = cx.v + rois.x1
WHERE cy.v < y2 - y1 AND cx.v < x2 - x1""")
def crop_pad(spark, sf):
    px = gray_pixels(spark, sf)
    images = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width")
    )
    cut = crop.crop_pad(px, images, nation_rois(spark, sf))
    return cut.select("image_id", "label", "y", "x", "p")


@query("crop_packed", f"""WITH {CPX}, {ROIS}
SELECT cpx.image_id, rois.label, cpx.y - greatest(y1, 0) AS y, cpx.x - greatest(x1, 0) AS x, b, g, r
FROM cpx JOIN rois ON cpx.image_id % 5 = rois.config
WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2""")
def crop_packed(spark, sf):
    """Whole image rows joined to their regions, cut to the region before anything else happens."""
    images = packed_colour(spark, sf).drop("label").withColumn("config", (F.col("image_id") % 5).cast("int"))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    cut = images.join(crop.usable_rois(nation_rois(spark, sf)), "config").select(
        "image_id", "label", packed.crop(F.col("image"), *box).alias("image")
    )
    cells = packed.unpack(cut.filter("image is not null"))
    return (
        cells.groupBy("image_id", "label", "y", "x")
        .agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("bgr")])
    )


@query("crop_rejects", f"""WITH {ROIS}
SELECT v.vec_id AS image_id, rois.label, CASE WHEN x2 < x1 THEN 'right before left' WHEN y2 < y1 THEN 'bottom above top' ELSE 'empty box' END AS reason
FROM embeddings v JOIN rois ON v.vec_id % 5 = rois.config WHERE x2 <= x1 OR y2 <= y1""")
def crop_rejects(spark, sf):
    images = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), (F.col("vec_id") % 5).cast("int").alias("config")
    )
    return images.join(crop.crop_rejects(nation_rois(spark, sf)), "config").select("image_id", "label", "reason")


@query("roi_pairs", f"""WITH {ROIS}
SELECT vec_id AS image_id, rois.label, ord FROM embeddings, rois""")
def roi_pairs(spark, sf):
    images = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"))
    return crop.pair_with_rois(images, nation_rois(spark, sf)).select("image_id", "label", "ord")


@query("roi_range_join", f"""WITH {PX},
r AS (SELECT CAST(s_suppkey % 10 AS INTEGER) AS label, s_name AS roi, CAST(s_suppkey % 6 AS INTEGER) AS x1,
             CAST(s_nationkey % 5 AS INTEGER) AS y1, CAST(s_suppkey % 6 + 3 AS INTEGER) AS x2, CAST(s_nationkey % 5 + 2 AS INTEGER) AS y2 FROM supplier)
SELECT px.image_id, r.roi, count(*) AS n, CAST(sum(p) AS BIGINT) AS total
FROM px JOIN r ON px.label = r.label AND x >= x1 AND x < x2 AND y >= y1 AND y < y2
GROUP BY px.image_id, r.roi""")
def roi_range_join(spark, sf):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    rois = table(spark, sf, "supplier").select(
        (key % 10).cast("int").alias("label"), F.col("s_name").alias("roi"),
        (key % 6).cast("int").alias("x1"), (nation % 5).alias("y1"),
        (key % 6 + 3).cast("int").alias("x2"), (nation % 5 + 2).alias("y2"),
    )
    return crop.roi_figures(gray_pixels(spark, sf, "label"), rois, "image_id", "roi", "p", ["label"], tile=4)


@query("roi_crop_threshold", f"""WITH {PX}, {ROIS}
SELECT px.image_id, rois.label, count(*) AS n, CAST(count(*) FILTER (WHERE p > 127) AS BIGINT) AS white, CAST(sum(p) AS BIGINT) AS total
FROM px JOIN rois ON x >= x1 AND x < x2 AND y >= y1 AND y < y2
GROUP BY px.image_id, rois.label""")
def roi_crop_threshold(spark, sf):
    """Flagship: images and regions to crops, black/white conversion, figures per crop."""
    cut = crop.crop_clip(gray_pixels(spark, sf), nation_rois(spark, sf))
    bw = pixels.threshold(cut.withColumn("level", F.col("p")))
    return bw.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == 255).alias("white"), F.sum("level").alias("total")
    )
