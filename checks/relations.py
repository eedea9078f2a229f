"""Joins, aggregations, set accounting and ordered analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table
from glyphray.functions import names
from glyphray.operators import chain, checks, headers, history, joins, runs
from glyphray.session import with_fields
from glyphray.sources import nodes


# --- joins -------------------------------------------------------------------------------------


@query("stream_status", """
SELECT n_name AS stream, CASE WHEN bool_or(contains(c, n_name)) THEN 'Running' ELSE 'Stopped' END AS status
FROM nation, (SELECT 'svc-NATION_' || (s_suppkey % 13) || ': Up ' || s_nationkey || ' hours' AS c FROM supplier WHERE s_suppkey % 3 <> 0)
GROUP BY n_name""")
def stream_status(spark, sf):
    key = F.col("s_suppkey")
    containers = table(spark, sf, "supplier").filter(key % 3 != 0).select(
        F.concat(F.lit("svc-NATION_"), key % 13, F.lit(": Up "), F.col("s_nationkey"), F.lit(" hours")).alias("container")
    )
    streams = table(spark, sf, "nation").select(F.col("n_name").alias("stream"))
    return joins.stream_status(streams, containers)


@query("stream_status_exact", """
SELECT n_name AS stream, CASE WHEN n_nationkey IN (SELECT s_suppkey % 13 FROM supplier) THEN 'Running' ELSE 'Stopped' END AS status FROM nation""")
def stream_status_exact(spark, sf):
    containers = table(spark, sf, "supplier").select(
        F.concat(F.lit("NATION_"), F.col("s_suppkey") % 13, F.lit(": Up 3 hours")).alias("container")
    )
    streams = table(spark, sf, "nation").select(F.col("n_name").alias("stream"))
    return joins.stream_status(streams, containers, exact=True)


def _nodes(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("label"), F.concat(F.lit("/n/"), key).alias("path"),
        F.when(key % 2 == 0, "stopped").otherwise("running").alias("status"),
        F.when(key % 5 != 0, (key + 1).cast("int")).alias("pid"),
    )


def _live(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 49 and l_suppkey % 3 <> 0").select(F.col("l_suppkey").cast("int").alias("pid"))


_NODES = """nodes AS (SELECT s_name AS label, '/n/' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'stopped' ELSE 'running' END AS status,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey + 1 AS INTEGER) END AS pid FROM supplier),
live AS (SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS pid FROM lineitem WHERE l_quantity > 49 AND l_suppkey % 3 <> 0)"""


@query("node_liveness", f"""WITH {_NODES}
SELECT label, path, n.pid, l.pid IS NOT NULL AS alive, CASE WHEN l.pid IS NOT NULL THEN 'running' ELSE 'stopped' END AS status
FROM nodes n LEFT JOIN live l ON n.pid = l.pid""")
def node_liveness(spark, sf):
    return joins.node_liveness(_nodes(spark, sf), _live(spark, sf))


@query("startable_nodes", f"""WITH {_NODES}
SELECT label, path, pid, status FROM nodes WHERE status = 'stopped' AND (pid IS NULL OR pid NOT IN (SELECT pid FROM live))""")
def startable_nodes(spark, sf):
    return joins.startable_nodes(_nodes(spark, sf), _live(spark, sf)).select("label", "path", "pid", "status")


@query("resolve_modules", """
WITH a AS (SELECT lower(p_brand) AS module, min(p_size) < 2 AS is_enabled FROM part WHERE p_partkey % 7 < 3 GROUP BY 1),
w AS (SELECT p_partkey, CAST(generate_subscripts([1, 2, 3], 1) - 1 AS INTEGER) AS pos,
             unnest([lower(p_brand), 'brand#' || p_size, lower(p_type)]) AS module FROM part)
SELECT p_partkey, pos, w.module, CASE WHEN is_enabled IS NULL THEN 'missing' WHEN is_enabled THEN 'loaded' ELSE 'disabled' END AS status
FROM w LEFT JOIN a USING (module)""")
def resolve_modules(spark, sf):
    part = table(spark, sf, "part")
    configs = part.select(
        "p_partkey",
        F.concat(F.lower("p_brand"), F.lit(" , brand#"), F.col("p_size"), F.lit(","), F.lower("p_type")).alias("enabled"),
    )
    available = part.filter("p_partkey % 7 < 3").groupBy(F.lower("p_brand").alias("module")).agg(
        (F.min("p_size") < 2).alias("is_enabled")
    )
    return joins.resolve_modules(configs, available)


@query("module_order", """
SELECT p_partkey, CAST(generate_subscripts([1, 2, 3], 1) - 1 AS INTEGER) AS pos,
       unnest([p_type, lower(p_brand), p_name]) AS module FROM part""")
def module_order(spark, sf):
    listed = F.concat(F.col("p_type"), F.lit(", "), F.lower("p_brand"), F.lit("  ,"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(chain.split_names(listed)).alias("pos", "module"))


@query("join_lineage", """
WITH c AS (SELECT l_orderkey, l_linenumber, 'roi' || (l_suppkey % 4) AS label, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT '1.2.' || o_orderkey AS uid, o_orderpriority AS modality, CAST(l_linenumber AS INTEGER) AS slice_no, label, n AS pieces,
       CASE WHEN l_linenumber % 2 = 0 THEN 'text ' || label END AS text
FROM orders JOIN c ON l_orderkey = o_orderkey""")
def join_lineage(spark, sf):
    line = table(spark, sf, "lineitem")
    uid = F.concat(F.lit("1.2."), F.col("l_orderkey"))
    heads = table(spark, sf, "orders").select(
        F.concat(F.lit("1.2."), F.col("o_orderkey")).alias("uid"), F.col("o_orderpriority").alias("modality")
    )
    image = names.slice_name(uid, F.col("l_linenumber"))
    label = F.concat(F.lit("roi"), F.col("l_suppkey") % 4)
    # the parts of each name are worked out once, by generated code
    named = lambda df, name: with_fields(
        df, F.struct(names.lineage_parts(name).alias("parts"))
    ).select(names.lineage_record(F.col("parts")).alias("read")).select("read.*")
    slices = named(line, image).select("uid", "slice_no").distinct()
    crops = named(line, names.crop_name(image, label)).groupBy("uid", "slice_no", "label").agg(
        F.count(F.lit(1)).alias("pieces")
    )
    texts = named(line.filter("l_linenumber % 2 = 0"), names.report_name(names.crop_name(image, label))).select(
        "uid", "slice_no", "label"
    ).distinct().withColumn("text", F.concat(F.lit("text "), F.col("label")))
    return joins.join_lineage(heads, slices, crops, texts)


@query("duplicate_check", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'duplicate' ELSE 'new' END AS state FROM customer""")
def duplicate_check(spark, sf):
    known = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_state(table(spark, sf, "customer").select("c_custkey"), known, ["c_custkey"])


# --- aggregations ------------------------------------------------------------------------------


@query("folder_depth", "SELECT event_type AS folder, count(*) AS n_files FROM events GROUP BY 1")
def folder_depth(spark, sf):
    return history.folder_depth(table(spark, sf, "events").select(F.col("event_type").alias("folder")))


@query("used_modules_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = '' AND b = '' AND c = '' THEN 'Geen modules gebruikt'
  ELSE concat_ws(', ', nullif(a, ''), nullif(b, ''), nullif(c, '')) END AS modules
FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'convert_black_white' ELSE '' END AS a, CASE WHEN l_discount > 0.05 THEN 'Medianblur' ELSE '' END AS b,
      CASE WHEN l_tax > 0.04 THEN 'upscaling' ELSE '' END AS c FROM lineitem)""")
def used_modules_text(spark, sf):
    used = F.array_compact(F.array(
        F.when(F.col("l_quantity") > 25, "convert_black_white"),
        F.when(F.col("l_discount") > 0.05, "Medianblur"),
        F.when(F.col("l_tax") > 0.04, "upscaling"),
    ))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", chain.used_modules_text(used).alias("modules")
    )


@query("any_match", """
SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1""")
def any_match(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


# event type -> what a run log would say
_MESSAGES = {
    "signup": "Script gestart.", "view": "Start headers...", "click": "headers gestopt.",
    "purchase": "Start slices...", "error": "slices gestopt.",
}
_OUTCOMES = {
    "signup": "✅ DICOM header succesvol als JSON opgeslagen: /out/a.json", "view": "Slice 1 opgeslagen als /out/a.jpg",
    "click": "Bestand overgeslagen (geen DICOM): b.txt", "purchase": "❌ Fout bij verwerken van DICOM-bestand: x",
    "error": "Fout bij het converteren van DICOM naar JPG: y",
}


def _say(texts):
    out = F.lit(None).cast("string")
    for k, v in texts.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


@query("run_counts", """
SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS slices,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS BIGINT) AS failed
FROM events GROUP BY user_id""")
def run_counts(spark, sf):
    logs = table(spark, sf, "events").select("user_id", _say(_OUTCOMES).alias("message"))
    return history.run_counts(logs, ["user_id"])


@query("action_counts", """
SELECT user_id AS label, count(*) FILTER (WHERE event_type = 'view') AS gestart, count(*) FILTER (WHERE event_type = 'click') AS gestopt,
       count(*) FILTER (WHERE event_type = 'signup') AS toegevoegd, count(*) FILTER (WHERE event_type = 'purchase') AS verwijderd,
       count(*) FILTER (WHERE event_type = 'error') AS mislukt FROM events GROUP BY 1""")
def action_counts(spark, sf):
    names = {"view": "gestart", "click": "gestopt", "signup": "toegevoegd", "purchase": "verwijderd", "error": "mislukt"}
    actions = table(spark, sf, "events").select(F.col("user_id").alias("label"), _say(names).alias("action"))
    return history.action_counts(actions, list(names.values()))


# --- ordered analytics -------------------------------------------------------------------------


@query("roi_numbering", """
SELECT p_brand AS config, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS roi_no FROM part""")
def roi_numbering(spark, sf):
    rois = table(spark, sf, "part").select(F.col("p_brand").alias("config"), "p_partkey")
    return runs.numbered(rois, ["config"], ["p_partkey"], runs.block("p_partkey", 500), "roi_no")


@query("roi_last_wins", """
WITH r AS (SELECT l_suppkey, l_returnflag || l_linenumber AS label, l_orderkey * 100000 + l_partkey AS ord, CAST(l_quantity AS INTEGER) AS x1 FROM lineitem)
SELECT l_suppkey, label, min(ord) AS first_ord, max(ord) AS last_ord, max_by(x1, ord * 100 + x1) AS x1 FROM r GROUP BY ALL""")
def roi_last_wins(spark, sf):
    x1, order = F.col("l_quantity").cast("int"), F.col("l_orderkey") * 100000 + F.col("l_partkey")
    rois = table(spark, sf, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linenumber").alias("label"), order.alias("ord"), x1.alias("x1")
    )
    return headers.last_wins(rois, ["l_suppkey", "label"], ["ord", "x1"])


@query("stage_durations", """
WITH m AS (SELECT user_id AS source, event_id AS line_no, ts, event_type,
                  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_id,
                  CASE WHEN event_type IN ('view', 'click') THEN 'headers' WHEN event_type IN ('purchase', 'error') THEN 'slices' END AS stage,
                  event_type IN ('click', 'error') AS is_stop FROM events),
p AS (SELECT *, lead(CASE WHEN is_stop THEN ts END) OVER (PARTITION BY source, run_id, stage ORDER BY ts, line_no) AS ended FROM m WHERE stage IS NOT NULL)
SELECT source, CAST(run_id AS BIGINT) AS run_id, stage, line_no, ts AS started, ended FROM p WHERE NOT is_stop""")
def stage_durations(spark, sf):
    logs = table(spark, sf, "events").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("line_no"), "ts", _say(_MESSAGES).alias("message")
    )
    return history.stage_durations(logs)


@query("latest_header", """
SELECT user_id, max_by(event_id, ts) AS event_id, max(ts) AS ts, max_by(value, ts) AS value FROM events GROUP BY user_id""")
def latest_header(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return headers.latest_per_key(rows, ["user_id"], ["ts", "event_id"])


@query("up_intervals", """
WITH a AS (SELECT user_id AS label, ts, event_id, event_type = 'view' AS up FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT *, lag(up) OVER (PARTITION BY label ORDER BY ts, event_id) AS was FROM a),
f AS (SELECT * FROM e WHERE up <> coalesce(was, false)),
g AS (SELECT label, up, ts AS up_at, lead(ts) OVER (PARTITION BY label ORDER BY ts, event_id) AS down_at FROM f)
SELECT label, up_at, down_at FROM g WHERE up""")
def up_intervals(spark, sf):
    actions = table(spark, sf, "events").select(F.col("user_id").alias("label"), "ts", "event_id", "event_type")
    kind = F.col("event_type")
    return history.up_intervals(actions, kind == "view", kind == "click")


@query("heartbeat_sessions", """
WITH l AS (SELECT user_id AS node, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY ts, event_id) AS no FROM l)
SELECT node, CAST(no AS BIGINT) AS session_no, min(ts) AS first_beat, max(ts) AS last_beat, count(*) AS beats FROM s GROUP BY node, no""")
def heartbeat_sessions(spark, sf):
    beats = table(spark, sf, "events").select(F.col("user_id").alias("node"), "ts", "event_id")
    return history.sessions(beats, 7200)


@query("retention", """
SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 HOUR""")
def retention(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    now = events.agg(F.max("ts").alias("now"))  # one row
    return history.retained(events.join(F.broadcast(now), F.lit(True)), F.col("now"), 36_000).drop("now")


@query("outbox_state", """
SELECT user_id AS file, count(*) AS attempts, CASE WHEN max_by(event_type = 'purchase', ts) THEN 'sent' ELSE 'pending' END AS state FROM events GROUP BY 1""")
def outbox_state(spark, sf):
    attempts = table(spark, sf, "events").select(
        F.col("user_id").alias("file"), "ts", "event_id", (F.col("event_type") == "purchase").alias("ok")
    )
    return history.outbox(attempts)


# --- accounting --------------------------------------------------------------------------------


@query("good_and_rejects", """
SELECT state, count(*) AS n, CAST(count(DISTINCT value) AS BIGINT) AS texts FROM (
  SELECT CASE WHEN c_custkey % 10 IN (0, 1) THEN 'reject' ELSE 'good' END AS state, c_custkey AS value FROM customer) GROUP BY 1
UNION ALL SELECT 'difference', 0, 0""")
def good_and_rejects(spark, sf):
    """Good and rejected lines, and the rows by which they fail to add up to the input (none)."""
    lines = customer_lines(spark, sf).select("value")
    good, bad = nodes.read_node_registry(lines)
    gap = checks.accounting(lines, good.select("value"), bad.select("value"))
    count = lambda df, state: df.agg(
        F.lit(state).alias("state"), F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("texts")
    )
    return count(good, "good").unionByName(count(bad, "reject")).unionByName(count(gap, "difference"))


def customer_lines(spark, sf):
    """Node list lines; every tenth lacks a field, every tenth has one too many."""
    key = F.col("c_custkey")
    line = F.concat_ws("|", "c_name", F.concat(F.lit("/n/"), key), "c_mktsegment", F.when(key % 3 == 0, "").otherwise(key.cast("string")))
    broken = F.when(key % 10 == 0, F.concat_ws("|", "c_name", "c_mktsegment", key.cast("string")))
    extra = F.when(key % 10 == 1, F.concat(line, F.lit("|x")))
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.coalesce(broken, extra, line), F.lit("\n")).alias("value"))
