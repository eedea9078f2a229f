"""Module chains, recognition, text and structured reports, nested items."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import CPX, GRAY, PX, ROIS, box_mean_sql, nation_rois, packed_colour, packed_gray
from checks.registry import query, table
from glyphray.functions.names import slice_name
from glyphray.operators import chain, headers, packed, reports
from glyphray.plans.images import crop_images, read_text, report



def _cells(df):
    return packed.unpack_gray(df).drop("height", "width")


# --- module chain ------------------------------------------------------------------------------

_BW = chain.REGISTRY["convert_black_white"]


@query("chain_black_white", f"""WITH {CPX}
SELECT image_id, 'convert_black_white' AS used, CAST(NULL AS VARCHAR) AS error, y, x, CASE WHEN {GRAY} > 127 THEN 255 ELSE 0 END AS p FROM cpx""")
def chain_black_white(spark, sf):
    """A module without a process is skipped; the other one turns the image black and white."""
    modules, _ = chain.load_order(["adaptive_threshold", " convert_black_white "])
    done = chain.apply_chain(packed_colour(spark, sf).drop("label"), modules)
    return _cells(done.withColumn("used", F.array_join("used", ",")))


@query("chain_first_error_stops", f"""WITH {CPX}, gray AS (SELECT *, {GRAY} AS p FROM cpx), {box_mean_sql('gray', 1, 'm')}
SELECT image_id, 'tuned' AS used, 'three channels expected' AS error, y, x, CASE WHEN p > mean - 2 THEN 255 ELSE 0 END AS p FROM m""")
def chain_first_error_stops(spark, sf):
    """The second module needs colour, finds gray and stops the chain; the first result stays."""
    tuned = chain.from_kernel("tuned", lambda a: packed.adaptive_of(packed.gray_of(a), 3, 2))
    done = chain.apply_chain(packed_colour(spark, sf).drop("label"), [tuned, _BW, chain.REGISTRY["select_region"]])
    return _cells(done.withColumn("used", F.array_join("used", ",")))


@query("chain_null_reloads", f"""WITH {CPX}
SELECT image_id, 'select_region,convert_black_white' AS used, y, x, CASE WHEN {GRAY} > 100 THEN 255 ELSE 0 END AS p FROM cpx""")
def chain_null_reloads(spark, sf):
    """An empty selection yields no image, so the next module starts from the original."""
    modules = [chain.REGISTRY["select_region"], _BW.with_params(level=100)]
    done = chain.apply_chain(packed_colour(spark, sf).drop("label"), modules).drop("error")
    return _cells(done.withColumn("used", F.array_join("used", ",")))


@query("chain_select_region", f"""WITH {CPX}
SELECT image_id, y - 1 AS y, x - 2 AS x, CASE WHEN {GRAY} > 127 THEN 255 ELSE 0 END AS p FROM cpx WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 6""")
def chain_select_region(spark, sf):
    modules = [chain.REGISTRY["select_region"].with_params(box=(2, 1, 4, 5)), _BW]
    done = chain.apply_chain(packed_colour(spark, sf).drop("label"), modules).drop("error", "used")
    return _cells(done)


@query("chain_select_after_module", f"""WITH {CPX}, gray AS (SELECT *, {GRAY} AS p FROM cpx), {box_mean_sql('gray', 1, 'm')}
SELECT image_id, 'tuned,select_region,convert_black_white' AS used, y, x, CASE WHEN p > mean - 2 THEN 255 ELSE 0 END AS p FROM m WHERE x < 5 AND y < 4""")
def chain_select_after_module(spark, sf):
    """Selecting from a gray image turns the selection into colour, so a colour module may follow."""
    tuned = chain.from_kernel("tuned", lambda a: packed.adaptive_of(packed.gray_of(a), 3, 2))
    modules = [tuned, chain.REGISTRY["select_region"].with_params(box=(0, 0, 5, 4)), _BW]
    done = chain.apply_chain(packed_colour(spark, sf).drop("label"), modules).drop("error")
    return _cells(done.withColumn("used", F.array_join("used", ",")))


@query("chain_no_modules", f"WITH {PX} SELECT image_id, 'Geen modules gebruikt' AS modules, y, x, p FROM px")
def chain_no_modules(spark, sf):
    same = chain.processed_or_original(packed_gray(spark, sf).drop("label"), [])
    return _cells(same.select("image_id", "image", chain.used_modules_text(F.col("used")).alias("modules")))


def _brightness_reader():
    """Deterministic stand-in for a recogniser: one text per image line, blank for dark lines."""
    import numpy as np

    def read(image):
        for y, line in enumerate(image.astype(np.int64).sum(axis=(1, 2))):
            if line > 1800:
                raise ValueError(f"line {y} is too bright")
            text = f" {line} " if line > 900 else " \t"
            yield [(0, y), (image.shape[1], y), (image.shape[1], y + 1), (0, y + 1)], text, 0.5

    return read


@query("recognize", f"""WITH {PX}, l AS (SELECT image_id, y, CAST(sum(p) AS BIGINT) AS s FROM px GROUP BY ALL),
bad AS (SELECT image_id, min(y) FILTER (WHERE s > 1800) AS b FROM l GROUP BY 1)
SELECT image_id, y AS line_no, ' ' || s || ' ' AS text, 0.5::DOUBLE AS confidence, y AS y1, 8 AS x2, CAST(NULL AS VARCHAR) AS ocr_error
FROM l JOIN bad USING (image_id) WHERE b IS NULL AND s > 900
UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, NULL, 'line ' || b || ' is too bright' FROM bad WHERE b IS NOT NULL""")
def recognize(spark, sf):
    read = chain.recognize(packed_gray(spark, sf), _brightness_reader)
    rows = read.select("image_id", "ocr_error", F.inline_outer("lines"))
    kept = rows.filter("ocr_error is not null or trim(BOTH ' \t' FROM text) <> ''")
    return kept.select("image_id", "line_no", "text", "confidence", "y1", "x2", "ocr_error")


# --- text report -------------------------------------------------------------------------------


@query("ocr_report_lines", """
WITH t AS (SELECT 'conv/' || conv_id || '.jpg' AS image_path, turn AS line_no, CASE WHEN turn % 3 = 2 THEN '   ' ELSE ' ' || text END AS line, conv_id FROM conversations),
i AS (SELECT DISTINCT image_path, conv_id FROM t)
SELECT image_path, 0 AS part, CAST(0 AS BIGINT) AS line_no, 'Resultaten voor afbeelding: ' || image_path AS line FROM i
UNION ALL SELECT image_path, 1, 0, 'Gebruikte modules: ' || CASE WHEN conv_id % 2 = 0 THEN 'upscaling, Medianblur' ELSE 'Geen modules gebruikt' END FROM i
UNION ALL SELECT image_path, 2, line_no, line FROM t WHERE trim(line) <> ''
UNION ALL SELECT image_path, 3, 0, '' FROM i""")
def ocr_report_lines(spark, sf):
    images, texts = _conversation_report(spark, sf)
    return reports.report_lines(images, texts)


def _conversation_report(spark, sf):
    turns = table(spark, sf, "conversations")
    path = F.concat(F.lit("conv/"), F.col("conv_id"), F.lit(".jpg")).alias("image_path")
    used = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("upscaling"), F.lit("Medianblur"))).otherwise(
        F.array().cast("array<string>")
    )
    images = turns.select("conv_id").distinct().select(path, used.alias("used"))
    blank = F.when(F.col("turn") % 3 == 2, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("text")))
    return images, turns.select(path, F.col("turn").alias("line_no"), blank.alias("text"))


# --- structured report -------------------------------------------------------------------------


def _scalars():
    day = F.date_format("o_orderdate", "yyyyMMdd")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return {
        "study_date": day, "series_date": day, "content_date": day, "accession_number": key,
        "modality": F.lit("SR"), "manufacturer": F.col("o_orderpriority"), "station_name": F.col("o_orderstatus"),
        "study_instance_uid": F.concat(F.lit("1.2."), key), "study_id": cust, "content_label": F.lit("PE"),
    }


def _groups():
    key = F.col("o_orderkey")
    code = lambda i: F.when(key % 5 == i, "74019-1").otherwise(f"1210{i}")
    return [(code(i), F.lit(f"meaning {i}"), F.concat(F.lit(f"{i}:"), F.col("o_orderpriority"))) for i in range(5)]


def _reports(spark, sf):
    return reports.build_report(table(spark, sf, "orders"), F.col("o_orderkey").cast("string"), _scalars(), _groups(), ["o_orderkey"])


_UID = "'2.25.' || CAST(CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) AS VARCHAR)"


@query("report_build", f"""
SELECT o_orderkey, 'ISO_IR 100' AS charset, '1.2.840.10008.5.1.4.1.1.88.33' AS sop_class_uid, {_UID} AS sop_instance_uid,
       '' AS referring_physician_name, strftime(o_orderdate, '%Y%m%d') AS study_date, CAST(o_orderkey AS VARCHAR) AS accession_number,
       o_orderpriority AS manufacturer, CAST(NULL AS VARCHAR) AS series_number, 'PE' AS content_label, 5 AS items FROM orders""")
def report_build(spark, sf):
    r = F.col("report")
    return _reports(spark, sf).select(
        "o_orderkey", r["specific_character_set"].alias("charset"), r["sop_class_uid"].alias("sop_class_uid"),
        *[r[c].alias(c) for c in ("sop_instance_uid", "referring_physician_name", "study_date", "accession_number",
                                  "manufacturer", "series_number", "content_label")],
        F.size(r["content"]).alias("items"),
    )


_ITEMS = """items AS (
  SELECT o_orderkey, CAST(i AS INTEGER) AS item_no, 'CONTAINS' AS relationship, 'TEXT' AS value_type,
         CASE WHEN o_orderkey % 5 = i THEN '74019-1' ELSE '1210' || i END AS code, CASE WHEN o_orderkey % 5 = i THEN 'LN' ELSE 'DCM' END AS scheme,
         'meaning ' || i AS meaning, i || ':' || o_orderpriority AS text
  FROM orders, range(5) t(i))"""


@query("report_items", f"WITH {_ITEMS} SELECT * FROM items")
def report_items(spark, sf):
    return reports.flat_items(_reports(spark, sf).select("o_orderkey", "report.content"))


@query("report_uid", f"SELECT o_orderkey, {_UID} AS uid FROM orders")
def report_uid(spark, sf):
    return _reports(spark, sf).select("o_orderkey", F.col("report.sop_instance_uid").alias("uid"))


@query("report_json", f"""
SELECT o_orderkey, json_extract_string(d, '$.study_date') AS study_date, json_extract_string(d, '$.sop_instance_uid') AS uid, json_extract_string(d, '$.content[0].concept[0].scheme') AS scheme,
       json_extract_string(d, '$.content[4].text') AS last_text
FROM (SELECT o_orderkey, json_object('study_date', strftime(o_orderdate, '%Y%m%d'), 'sop_instance_uid', {_UID},
  'content', [{{'concept': [{{'scheme': CASE WHEN o_orderkey % 5 = 0 THEN 'LN' ELSE 'DCM' END}}], 'text': '0'}}, {{'concept': [], 'text': '1'}}, {{'concept': [], 'text': '2'}},
  {{'concept': [], 'text': '3'}}, {{'concept': [], 'text': '4:' || o_orderpriority}}]) AS d FROM orders)""")
def report_json(spark, sf):
    docs = reports.report_json(_reports(spark, sf))
    get = lambda path: F.get_json_object("document", path)
    return docs.select(
        "o_orderkey", get("$.study_date").alias("study_date"), get("$.sop_instance_uid").alias("uid"),
        get("$.content[0].concept[0].scheme").alias("scheme"), get("$.content[4].text").alias("last_text"),
    )


@query("report_findings", f"""WITH {_ITEMS}
SELECT o_orderkey AS study, min(text) FILTER (WHERE code = '74019-1') AS "74019-1", min(text) FILTER (WHERE code = '12100') AS "12100",
       min(text) FILTER (WHERE code = '12101') AS "12101", min(text) FILTER (WHERE code = '12102') AS "12102",
       min(text) FILTER (WHERE code = '12103') AS "12103", min(text) FILTER (WHERE code = '12104') AS "12104" FROM items GROUP BY 1""")
def report_findings(spark, sf):
    items = reports.flat_items(_reports(spark, sf).select(F.col("o_orderkey").alias("study"), "report.content"))
    return reports.findings(items, ["74019-1", "12100", "12101", "12102", "12103", "12104"])


@query("first_concept", """
SELECT l_orderkey, min_by(l_linenumber || ':' || l_partkey, row(l_linenumber, l_partkey, l_suppkey)) AS first_item FROM lineitem GROUP BY 1""")
def first_concept(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return reports.first_item(line, "l_orderkey", "o", F.concat_ws(":", "l_linenumber", "l_partkey"))


# --- nested items ------------------------------------------------------------------------------


@query("nested_item_defaults", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE 'UNKNOWN' END AS patient_name, 'UNKNOWN' AS patient_id, role, CAST(3 AS INTEGER) AS fields FROM conversations""")
def nested_item_defaults(spark, sf):
    item = F.when(
        F.col("turn") % 3 == 0, F.create_map(F.lit("PatientName"), F.col("role"), F.lit("role"), F.col("role"))
    ).otherwise(F.create_map(F.lit("role"), F.col("role")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", headers.with_item_defaults(F.array(item)).alias("items"))
    m = F.get("items", F.lit(0))
    return rows.select(
        "conv_id", "turn", m["PatientName"].alias("patient_name"), m["PatientID"].alias("patient_id"),
        m["role"].alias("role"), F.size(m).alias("fields"),
    )


@query("nested_flatten", """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations),
a AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w)
SELECT conv_id, turn, 0 AS depth, CAST(i AS VARCHAR) AS path, word AS value, CAST(NULL AS BIGINT) AS size FROM a
UNION ALL SELECT conv_id, turn, 1, i || '/' || j, word || j, NULL FROM a, range(2) t(j)
UNION ALL SELECT conv_id, turn, 2, i || '/' || j || '/0', '^' || word, NULL FROM a, range(2) t(j) WHERE j = 1
UNION ALL SELECT conv_id, turn, 3, i || '/' || j || '/0/0', '_' || word, length(word) FROM a, range(2) t(j) WHERE j = 1""")
def nested_flatten(spark, sf):
    """Four levels of items, as in sequences within sequences; the deepest has a field of its own."""
    words = F.split("text", " ", -1)
    leaf = lambda w: F.struct(
        F.concat(F.lit("^"), w).alias("value"),
        F.array(F.struct(F.concat(F.lit("_"), w).alias("value"), F.length(w).cast("long").alias("size"))).alias("items"),
    )
    child = lambda w, j: F.struct(
        F.concat(w, F.lit(str(j))).alias("value"),
        (F.array(leaf(w)) if j else F.array().cast("array<struct<value:string,items:array<struct<value:string,size:bigint>>>>")).alias("items"),
    )
    nested = F.transform(words, lambda w: F.struct(w.alias("value"), F.array(child(w, 0), child(w, 1)).alias("items")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", nested.alias("sequence"))
    flat = headers.flatten_items(rows, "sequence")
    return flat.withColumn("item_path", F.array_join(F.col("item_path").cast("array<string>"), "/")).withColumnRenamed("item_path", "path")


# --- whole image flow --------------------------------------------------------------------------


def _white_counter():
    """Stand-in recogniser: per image line the number of white pixels, blank where there are none."""
    def read(image):
        for y, line in enumerate((image == 255).sum(axis=(1, 2))):
            yield [(0, y), (1, y)], str(line) if line else " ", 1.0

    return read


@query("crop_and_read", f"""WITH {CPX}, {ROIS}, named AS (SELECT *, '1.' || image_id || '_slice_1_' || label || '.jpg' AS path FROM (
  SELECT cpx.image_id, rois.label, y - greatest(y1, 0) AS line, CASE WHEN {GRAY} > 127 THEN 1 ELSE 0 END AS w FROM cpx JOIN rois ON x >= x1 AND x < x2 AND y >= y1 AND y < y2)),
l AS (SELECT path, line, sum(w) AS n FROM named GROUP BY ALL), i AS (SELECT DISTINCT path FROM named)
SELECT path AS image_path, 0 AS part, CAST(0 AS BIGINT) AS line_no, 'Resultaten voor afbeelding: ' || path AS line FROM i
UNION ALL SELECT path, 1, 0, 'Gebruikte modules: convert_black_white' FROM i
UNION ALL SELECT path, 2, line, CAST(n AS VARCHAR) FROM l WHERE n > 0
UNION ALL SELECT path, 3, 0, '' FROM i""")
def crop_and_read(spark, sf):
    """Images and regions to crops, module chain, recogniser, report lines."""
    images = packed_colour(spark, sf).select(
        slice_name(F.concat(F.lit("1."), F.col("image_id")), F.lit(1)).alias("image_name"), "image"
    )
    crops = crop_images(images, nation_rois(spark, sf)).filter("image is not null")
    return report(read_text(crops, [_BW], _white_counter))
