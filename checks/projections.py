"""Projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table
from glyphray.functions import header, names, roi
from glyphray.operators import chain, headers, joins
from glyphray.session import with_fields
from glyphray.sources import files


@query("patient_key", """
SELECT c_custkey,
       translate(coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE replace(c_name, '#', '^') || ' ' || c_mktsegment END, 'UNKNOWN'), '^ ', '__')
       || '_' || coalesce(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END, 'UNKNOWN') || '.json' AS file_name
FROM customer""")
def patient_key(spark, sf):
    key = F.col("c_custkey")
    name = F.when(key % 7 != 0, F.concat(F.translate("c_name", "#", "^"), F.lit(" "), F.col("c_mktsegment")))
    return table(spark, sf, "customer").select(
        key, header.patient_key(name, F.when(key % 11 != 0, key.cast("string"))).alias("file_name")
    )


@query("render_value", """
SELECT doc_id,
       CASE WHEN doc_id % 10 = 0 THEN 'UNREADABLE (no ' || lang || ')'
            WHEN doc_id % 3 = 0 THEN source
            ELSE substr(lower(hex(encode(text))), 1, 100) || '...' END AS value
FROM documents""")
def render_value(spark, sf):
    key = F.col("doc_id")
    raw = F.when(key % 3 != 0, F.encode("text", "utf-8"))
    error = F.when(key % 10 == 0, F.concat(F.lit("no "), F.col("lang")))
    return table(spark, sf, "documents").select(key, header.render_value(raw, F.col("source"), error).alias("value"))


@query("tag_label", """
SELECT p_partkey, format('({:04X},{:04X}) {}', CAST(p_partkey % 65536 AS INTEGER), CAST(p_size * 331 AS INTEGER), p_name) AS label FROM part""")
def tag_label(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        header.tag_label((F.col("p_partkey") % 65536).cast("int"), F.col("p_size") * 331, F.col("p_name")).alias("label"),
    )


@query("label_tags", """
WITH t AS (SELECT p_partkey, p_size * 65536 + CAST(p_partkey % 300 AS INTEGER) AS tag_no FROM part),
d AS (SELECT n_nationkey % 6 * 65536 + n_nationkey * 11 AS tag_no, n_name AS name FROM nation)
SELECT p_partkey, t.tag_no, format('({:04X},{:04X}) {}', tag_no // 65536, tag_no % 65536,
  CASE WHEN tag_no // 65536 % 2 = 0 THEN coalesce(name, '') WHEN name IS NOT NULL THEN '[' || name || ']'
       WHEN tag_no % 65536 BETWEEN 16 AND 255 THEN 'Private Creator' ELSE 'Private tag data' END) AS label
FROM t LEFT JOIN d USING (tag_no)""")
def label_tags(spark, sf):
    tags = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 65536 + (F.col("p_partkey") % 300).cast("int")).alias("tag_no")
    )
    key = F.col("n_nationkey")
    dictionary = table(spark, sf, "nation").select((key % 6 * 65536 + key * 11).alias("tag_no"), F.col("n_name").alias("name"))
    return headers.label_tags(tags, dictionary)


@query("header_map", """
WITH tags AS (
  SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN '(0010,0010) Patient''s Name' WHEN 1 THEN '(0010,0020) Patient ID'
                     WHEN 2 THEN 'status ' || l_linestatus ELSE 'flag ' || l_returnflag END AS k,
         CAST(l_partkey AS VARCHAR) AS v, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS o
  FROM lineitem),
d AS (SELECT l_orderkey, k, max_by(v, o) AS v, min(o) AS o FROM tags GROUP BY ALL)
SELECT l_orderkey,
       'PatientName=' || coalesce(max(v) FILTER (WHERE k LIKE '%Name'), 'UNKNOWN') || ';PatientID=' || coalesce(max(v) FILTER (WHERE k LIKE '%ID'), 'UNKNOWN')
       || ';' || string_agg(k || '=' || v, ';' ORDER BY o) AS header
FROM d GROUP BY l_orderkey""")
def header_map(spark, sf):
    n = F.col("l_linenumber") % 4
    tags = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(n == 0, "(0010,0010) Patient's Name").when(n == 1, "(0010,0020) Patient ID")
        .when(n == 2, F.concat(F.lit("status "), F.col("l_linestatus")))
        .otherwise(F.concat(F.lit("flag "), F.col("l_returnflag"))).alias("label"),
        F.col("l_partkey").cast("string").alias("value"),
        (F.col("l_linenumber") * F.lit(1_000_000_000).cast("bigint") + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"),
    )
    pairs = F.transform(F.map_entries("header"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return headers.header_map(tags).select(F.col("file_id").alias("l_orderkey"), F.array_join(pairs, ";").alias("header"))


@query("typed_header", """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS study_date,
       CASE WHEN o_orderkey % 30 >= 24 THEN NULL
            ELSE ((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_custkey % 60) * 1000000 + (o_orderkey % 1000) * 1000 END AS study_micros,
       CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate WHEN o_orderkey % 8 = 1 THEN o_orderdate + INTERVAL 12 HOUR - INTERVAL 90 MINUTE
            ELSE o_orderdate + to_microseconds((o_orderkey % 1000) * 1000) END AS acquired,
       (o_orderkey % 7) || '.5|' || (o_orderkey % 3) AS spacing, 'O''' || o_orderstatus || '|x y' AS names,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 100) / 4 END AS thickness,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS series_number,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus || '|' || o_orderpriority END AS image_type,
       o_orderpriority AS modality
FROM orders""")
def typed_header(spark, sf):
    key = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    millis = F.lpad((key % 1000).cast("string"), 3, "0")
    entries = {
        "(0008,0020) Study Date": F.when(key % 9 == 0, F.lit("19981399")).otherwise(day),
        "(0008,0030) Study Time": F.concat(two(key % 30), two(key % 60), two(F.col("o_custkey") % 60), F.lit("."), millis),
        "(0008,002A) Acquisition DateTime": F.when(key % 8 == 0, day).when(
            key % 8 == 1, F.concat(day, F.lit("1200+0130"))).otherwise(F.concat(day, F.lit("000000."), millis)),
        "(0028,0030) Pixel Spacing": F.concat(F.lit("["), (key % 7).cast("string"), F.lit(".5, "), (key % 3).cast("string"), F.lit("]")),
        "(0008,1070) Operators' Name": F.concat(F.lit("[\"O'"), F.col("o_orderstatus"), F.lit("\", 'x y']")),
        "(0018,0050) Slice Thickness": F.when(key % 6 == 0, F.lit("thin")).otherwise(((key % 100) / 4).cast("string")),
        "(0020,0011) Series Number": F.when(key % 5 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")),
        "(0008,0008) Image Type": F.when(key % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("['"), F.col("o_orderstatus"), F.lit("', '"), F.col("o_orderpriority"), F.lit("']"))
        ),
        "(0008,0060) Modality": F.col("o_orderpriority"),
    }
    maps = table(spark, sf, "orders").select(
        key, F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]).alias("header")
    )
    typed = headers.typed_header(maps, {
        "study_date": ("(0008,0020) Study Date", "date"),
        "study_micros": ("(0008,0030) Study Time", "time"),
        "acquired": ("(0008,002A) Acquisition DateTime", "timestamp"),
        "series_number": ("(0020,0011) Series Number", "int"),
        "image_type": ("(0008,0008) Image Type", "values"),
        "modality": ("(0008,0060) Modality", "text"),
        "spacing": ("(0028,0030) Pixel Spacing", "values"),
        "names": ("(0008,1070) Operators' Name", "values"),
        "thickness": ("(0018,0050) Slice Thickness", "double"),
    })
    return typed.withColumns({c: F.array_join(c, "|") for c in ("image_type", "spacing", "names")})


# region texts built from lineitem, every few of them broken in another way
_ROI_TEXT = """
  CASE CAST(l_orderkey AS BIGINT) % 9
    WHEN 0 THEN 'a' || l_linenumber || ':1,2,3'
    WHEN 1 THEN 'b:1,2,x,4'
    WHEN 2 THEN 'no colon 1,2,3,4'
    WHEN 3 THEN 'two:colons:1,2,3,4'
    WHEN 4 THEN 'c:1,2,3,4,' || l_linenumber
    ELSE ' ' || l_returnflag || ' : ' || l_partkey || ', -' || l_suppkey || ' ,+' || l_linenumber || ',' || CAST(l_quantity AS INTEGER) || ' ' END"""


def _roi_text():
    key, s = F.col("l_orderkey") % 9, lambda c: F.col(c).cast("string")
    return (
        F.when(key == 0, F.concat(F.lit("a"), s("l_linenumber"), F.lit(":1,2,3")))
        .when(key == 1, "b:1,2,x,4")
        .when(key == 2, "no colon 1,2,3,4")
        .when(key == 3, "two:colons:1,2,3,4")
        .when(key == 4, F.concat(F.lit("c:1,2,3,4,"), s("l_linenumber")))
        .otherwise(
            F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" : "), s("l_partkey"), F.lit(", -"), s("l_suppkey"),
                     F.lit(" ,+"), s("l_linenumber"), F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.lit(" "))
        )
    )


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("roi_parse", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS label, CAST(l_partkey AS INTEGER) AS x1,
       CAST(-l_suppkey AS INTEGER) AS y1, l_linenumber AS x2, CAST(l_quantity AS INTEGER) AS y2
FROM lineitem WHERE l_orderkey % 9 > 4""")
def roi_parse(spark, sf):
    texts = table(spark, sf, "lineitem").select(*_LINE, _roi_text().alias("raw"))
    return with_fields(texts, roi.parse_roi(F.col("raw"))).filter("reason is null").drop("raw", "reason")


@query("roi_rejects", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ROI_TEXT} AS raw,
       CASE WHEN l_orderkey % 9 IN (0, 4) THEN 'wrong number of coordinates' ELSE 'not a label with integer coordinates' END AS reason
FROM lineitem WHERE l_orderkey % 9 <= 4""")
def roi_rejects(spark, sf):
    texts = table(spark, sf, "lineitem").select(*_LINE, _roi_text().alias("raw"))
    return with_fields(texts, roi.parse_roi(F.col("raw"))).filter("reason is not null").select(*_LINE, "raw", "reason")


@query("roi_normalize", """
WITH s AS (SELECT *, (10 + l_linenumber * 15) / 100.0::DOUBLE AS zoom,
  CAST(l_partkey AS DOUBLE) - 500 AS ax, CAST(l_suppkey AS DOUBLE) AS ay, l_quantity * 3 AS bx, l_linenumber * 11.0::DOUBLE AS by_ FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(trunc(least(ax / zoom, bx / zoom)) AS INTEGER) AS x1, CAST(trunc(least(ay / zoom, by_ / zoom)) AS INTEGER) AS y1,
       CAST(trunc(greatest(ax / zoom, bx / zoom)) AS INTEGER) AS x2, CAST(trunc(greatest(ay / zoom, by_ / zoom)) AS INTEGER) AS y2
FROM s""")
def roi_normalize(spark, sf):
    zoom = (F.lit(10) + F.col("l_linenumber") * 15) / F.lit(100.0)
    box = roi.to_image(
        F.col("l_partkey").cast("double") - 500, F.col("l_suppkey").cast("double"),
        F.col("l_quantity") * 3, F.col("l_linenumber") * F.lit(11.0), zoom,
    )
    return table(spark, sf, "lineitem").select(*_LINE, box.alias("b")).select(*_LINE, "b.*")


@query("roi_scale", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(trunc((l_partkey - 900) * ((10 + l_linenumber * 15) / 100.0::DOUBLE)) AS INTEGER) AS sx,
       CAST(trunc(l_suppkey * ((10 + l_linenumber * 15) / 100.0::DOUBLE)) AS INTEGER) AS sy
FROM lineitem""")
def roi_scale(spark, sf):
    zoom = (F.lit(10) + F.col("l_linenumber") * 15) / F.lit(100.0)
    at = roi.to_screen(F.col("l_partkey") - 900, F.col("l_suppkey"), zoom)
    return table(spark, sf, "lineitem").select(*_LINE, at.alias("s")).select(*_LINE, "s.*")


@query("roi_validate", """
SELECT p_partkey, (p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 6 <> 0) AS valid FROM part""")
def roi_validate(spark, sf):
    key = F.col("p_partkey")
    label = F.when(key % 4 == 0, F.lit(" \t ")).otherwise(F.col("p_name"))
    number = lambda bad: F.when(bad, F.lit("1.5")).otherwise(F.concat(F.lit(" -"), F.col("p_size").cast("string")))
    empty = F.when(key % 6 == 0, F.lit("")).otherwise(F.lit("7"))
    coords = [number(key % 5 == 0), F.lit("12"), empty, F.lit("+3 ")]
    return table(spark, sf, "part").select(key, roi.valid_roi(label, coords).alias("valid"))


@query("roi_rect", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN ok THEN least(ax, bx) END AS x, CASE WHEN ok THEN least(ay, by_) END AS y,
       CASE WHEN ok THEN abs(bx - ax) END AS w, CASE WHEN ok THEN abs(by_ - ay) END AS h
FROM (SELECT *, CAST(l_quantity AS INTEGER) AS ax, CAST(l_suppkey % 20 AS INTEGER) AS ay, l_linenumber * 5 AS bx,
             CAST(l_partkey % 20 AS INTEGER) AS by_, CAST(l_quantity AS INTEGER) <> l_linenumber * 5 AND l_suppkey % 20 <> l_partkey % 20 AS ok FROM lineitem)""")
def roi_rect(spark, sf):
    rect = roi.rect_xywh(
        F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 20).cast("int"),
        F.col("l_linenumber") * 5, (F.col("l_partkey") % 20).cast("int"),
    )
    return table(spark, sf, "lineitem").select(*_LINE, rect.alias("r")).select(*_LINE, "r.x", "r.y", "r.w", "r.h")


@query("non_blank_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
p AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN line_no % 5 = 4 THEN chr(9) || ' ' || chr(160) ELSE '  ' || text END AS text FROM l)
SELECT * FROM p WHERE length(trim(text, ' ' || chr(9) || chr(160) || chr(13) || chr(11) || chr(12) || chr(133) || chr(8199) || chr(8239) || chr(12288))) > 0""")
def non_blank_lines(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")
    ).withColumn(
        "text", F.when(F.col("line_no") % 5 == 4, F.lit("\t  ")).otherwise(F.concat(F.lit("  "), F.col("text")))
    )
    read = lines.select("doc_id", F.array(F.struct("line_no", "text")).alias("lines"))
    return chain.text_lines(read, "doc_id")


@query("arrival_predicate", r"""
WITH n AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.dcm' WHEN 1 THEN url || '.DCM'
                  WHEN 2 THEN '/in.box/' || page_id ELSE '/in/SC.' || page_id END AS path FROM pages)
SELECT page_id, path FROM n WHERE path LIKE '%.dcm' OR position('.' IN regexp_extract(path, '[^/]*$')) = 0""")
def arrival_predicate(spark, sf):
    key, k = F.col("page_id"), F.col("page_id") % 4
    path = (
        F.when(k == 0, F.concat("url", F.lit(".dcm"))).when(k == 1, F.concat("url", F.lit(".DCM")))
        .when(k == 2, F.concat(F.lit("/in.box/"), key)).otherwise(F.concat(F.lit("/in/SC."), key))
    )
    return table(spark, sf, "pages").select(key, path.alias("path")).filter(names.is_arrival(F.col("path")))


@query("coding_scheme", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '74019-1' ELSE '1210' || (p_partkey % 3) END AS code,
       CASE WHEN p_partkey % 3 = 0 THEN 'LN' ELSE 'DCM' END AS scheme FROM part""")
def coding_scheme(spark, sf):
    key = F.col("p_partkey")
    code = F.when(key % 3 == 0, "74019-1").otherwise(F.concat(F.lit("1210"), (key % 3).cast("string")))
    return table(spark, sf, "part").select(key, code.alias("code")).withColumn("scheme", names.coding_scheme(F.col("code")))


@query("parse_lineage", """
SELECT o_orderkey, '1.3.6.' || o_custkey || '.' || o_orderkey AS uid, CAST(o_orderkey % 12 + 1 AS INTEGER) AS slice_no,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'waarde' || (o_orderkey % 5) END AS label
FROM orders""")
def parse_lineage(spark, sf):
    key, s = F.col("o_orderkey"), lambda c: c.cast("string")
    uid = F.concat(F.lit("1.3.6."), s(F.col("o_custkey")), F.lit("."), s(key))
    name = names.slice_name(uid, key % 12 + 1)
    named = F.when(key % 3 == 0, name).otherwise(names.crop_name(name, F.concat(F.lit("waarde"), s(key % 5))))
    full = F.when(key % 2 == 0, names.report_name(named)).otherwise(named)
    return with_fields(table(spark, sf, "orders").select(key, full.alias("name")), names.lineage(F.col("name"))).drop("name")


@query("complete_config", """
WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE ' NATION_' || (20 + s_suppkey % 40) || ' ' END AS stream,
                  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS script FROM supplier)
SELECT s_suppkey, trim(stream) AS stream FROM c
WHERE trim(stream) <> '' AND script <> '' AND trim(stream) NOT IN (SELECT n_name FROM nation)""")
def complete_config(spark, sf):
    key = F.col("s_suppkey")
    candidates = table(spark, sf, "supplier").select(
        key,
        F.when(key % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" NATION_"), key % 40 + 20, F.lit(" "))).alias("stream"),
        F.lit("/in").alias("input_map"),
        F.when(key % 7 == 0, F.lit("")).otherwise(F.col("s_name")).alias("docker_script"),
        F.lit("/map").alias("docker_map"), F.lit("c.json").alias("config_file"),
    )
    known = table(spark, sf, "nation").select(F.col("n_name").alias("stream"))
    return joins.complete_configs(candidates, known).select("s_suppkey", "stream")


@query("filter_magic", r"""
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS length FROM pages
WHERE substr(hex(encode(html)), 31, 10) = '3C68746D6C'""")
def filter_magic(spark, sf):
    """Same byte test as for header magic: fixed bytes at a fixed offset, here after the doctype."""
    content = F.encode("html", "utf-8")
    pages = table(spark, sf, "pages").select("page_id", content.alias("content"))
    hit = files.filter_magic(pages, 15, b"<html")
    return hit.select("page_id", F.length("content").cast("bigint").alias("length"))


@query("classify_files", r"""
SELECT CASE WHEN substr(hex(encode(html)), 257, 8) = '3C2F7469' THEN 'accepted' ELSE 'skipped' END AS status, count(*) AS n
FROM (SELECT CASE WHEN page_id % 3 = 0 THEN repeat('x', 128) || '</title>' WHEN page_id % 7 = 0 THEN 'short' ELSE html END AS html FROM pages) GROUP BY 1""")
def classify_files(spark, sf):
    key = F.col("page_id")
    body = F.when(key % 3 == 0, F.lit("x" * 128 + "</title>")).when(key % 7 == 0, "short").otherwise(F.col("html"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.encode(body, "utf-8").alias("content"))
    return files.classify_files(pages, magic=b"</ti").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("list_images", r"""
SELECT page_id, path FROM (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/a.JPG' WHEN 1 THEN '/b.jpeg' WHEN 2 THEN '/c.Png'
  WHEN 3 THEN '/d.jpgx' WHEN 4 THEN '/jpg' ELSE '' END AS path FROM pages)
WHERE lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg' OR lower(path) LIKE '%.png'""")
def list_images(spark, sf):
    k = F.col("page_id") % 6
    tail = F.lit("")
    for i, end in enumerate(("/a.JPG", "/b.jpeg", "/c.Png", "/d.jpgx", "/jpg")):
        tail = F.when(k == i, end).otherwise(tail)
    return files.list_images(table(spark, sf, "pages").select("page_id", F.concat("url", tail).alias("path")))
