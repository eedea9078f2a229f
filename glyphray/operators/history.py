"""What logs and queue events tell: counts, stage durations, up/down intervals, outages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.operators.runs import next_value, previous_value, running_sum, time_slot

# Time slot of the bucketed scans. A key has at most one summary row per slot (4,320 a month), and a
# node that wrote a third of 100 TB in a month still falls into pieces of a few GB. Choose a smaller
# slot for denser logs.
SLOT_SECONDS = 600

# Log texts that mark what happened to a file or a run.
RUN_START = "Script gestart."
PROCESSED = r"succesvol als JSON opgeslagen"
SLICE = r"^Slice \d+ opgeslagen als "
SKIPPED = r"^Bestand overgeslagen"
FAILED = r"^(❌ )?Fout bij "
STAGE_START = r"^Start (\w+)\.\.\.$"
STAGE_STOP = r"^(\w+) gestopt\.$"


def folder_depth(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Files per folder (queue depth)."""
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("n_files"))


def run_counts(logs: DataFrame, keys: Sequence[str], message: str = "message") -> DataFrame:
    """Processed, slices, skipped and failed per run, in one pass."""
    m = F.col(message)
    return logs.groupBy(*keys).agg(
        F.count_if(m.rlike(PROCESSED)).alias("processed"),
        F.count_if(m.rlike(SLICE)).alias("slices"),
        F.count_if(m.rlike(SKIPPED)).alias("skipped"),
        F.count_if(m.rlike(FAILED)).alias("failed"),
    )


def action_counts(actions: DataFrame, names: Sequence[str], label: str = "label", action: str = "action") -> DataFrame:
    """One row per node, one column per named action: a pivot with known columns, one exchange."""
    return actions.groupBy(label).agg(*[F.count_if(F.col(action) == n).alias(n) for n in names])


def stage_durations(logs: DataFrame, source: str = "source", ts: str = "ts", tie: str = "line_no",
                    message: str = "message", slot: int = SLOT_SECONDS) -> DataFrame:
    """Start and end of every stage per run; the end is null where the next mark is not its stop.

    A run is counted by the start messages its source has written so far.
    """
    m = F.col(message)
    begins, ends = F.regexp_extract(m, STAGE_START, 1), F.regexp_extract(m, STAGE_STOP, 1)
    mark = F.when(m == RUN_START, "run").when(begins != "", "start").when(ends != "", "stop")
    stage = F.when(begins != "", begins).otherwise(ends)
    marks = logs.select(source, ts, tie, mark.alias("mark"), stage.alias("stage")).filter("mark is not null")
    is_run = (F.col("mark") == "run").cast("int")
    bucket = time_slot(ts, slot)
    runs = running_sum(marks, [source], [ts, tie], bucket, is_run, ["mark", "stage"], "run_id")
    stages = runs.filter("mark <> 'run'").select(
        source, "run_id", "stage", ts, tie, (F.col("mark") == "stop").alias("is_stop")
    )
    paired = next_value(
        stages, [source, "run_id", "stage"], [ts, tie], bucket,
        F.when(F.col("is_stop"), F.col(ts)), ["is_stop"], "ended",
    )
    return paired.filter("not is_stop").select(source, "run_id", "stage", tie, F.col(ts).alias("started"), "ended")


def up_intervals(actions: DataFrame, started: Column, stopped: Column, node: str = "label", ts: str = "ts",
                 tie: str = "event_id", slot: int = SLOT_SECONDS) -> DataFrame:
    """Intervals a node was up: first start of an island to the stop that ends it (null if none).

    Repeated starts without a stop in between belong to one island.
    """
    marks = actions.filter(started | stopped).select(node, ts, tie, started.alias("up"))
    bucket = time_slot(ts, slot)
    seen = previous_value(marks, [node], [ts, tie], bucket, F.col("up"), ["up"], "was")
    # what remains alternates: a start that opens an island, the stop that closes it
    edges = seen.filter(F.col("up") != F.coalesce("was", F.lit(False))).drop("was")
    stop = F.when(~F.col("up"), F.col(ts))
    closed = next_value(edges, [node], [ts, tie], bucket, stop, ["up"], "down_at")
    return closed.filter("up").select(node, F.col(ts).alias("up_at"), "down_at")


def sessions(beats: DataFrame, gap_seconds: int, node: str = "node", ts: str = "ts", tie: str = "event_id",
             slot: int = SLOT_SECONDS) -> DataFrame:
    """Unbroken heartbeat stretches per node; the space between two of them is an outage.

    Batch twin of ``session_window``: the break test looks only at the previous beat, so a node with
    most of the beats is still spread over time slots.
    """
    bucket = time_slot(ts, slot)
    lagged = previous_value(beats.select(node, ts, tie), [node], [ts, tie], bucket, F.col(ts), [], "before")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = F.col("before").isNull() | (micros(ts) - micros("before") >= gap_seconds * 1_000_000)
    starts = lagged.select(node, ts, tie, fresh.cast("int").alias("fresh"))
    counted = running_sum(starts, [node], [ts, tie], bucket, F.col("fresh"), ["fresh"], "session_no")
    return counted.groupBy(node, "session_no").agg(
        F.min(ts).alias("first_beat"), F.max(ts).alias("last_beat"), F.count(F.lit(1)).alias("beats")
    )


def retained(files: DataFrame, now: Column, seconds: int = 10, ts: str = "ts") -> DataFrame:
    """Received files that are still inside their retention time."""
    return files.filter(F.col(ts) > now - F.make_dt_interval(secs=F.lit(seconds)))


def outbox(attempts: DataFrame, file: str = "file", ts: str = "ts", tie: str = "event_id",
           ok: str = "ok") -> DataFrame:
    """Per queued file: attempts so far and whether the latest one got through."""
    order = F.struct(ts, tie)
    last = F.max_by(ok, order)
    return attempts.groupBy(file).agg(
        F.count(F.lit(1)).alias("attempts"), F.when(last, "sent").otherwise("pending").alias("state")
    )


def last_status(statuses: DataFrame, node: str = "node", ts: str = "ts", tie: str = "event_id",
                status: str = "status") -> DataFrame:
    return statuses.groupBy(node).agg(F.max_by(status, F.struct(ts, tie)).alias("status"))
