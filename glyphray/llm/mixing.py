"""Weighted fair queueing of shuffled documents over sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphray.llm.store import scratch, stored

# Slices of the shuffled order of a source, and bins of virtual time: fixed, so their tables stay small at any size.
SLICES = 4096
BINS = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Target of each source: its weight's share of all sizes, at most ``most`` times its own size.

    ``sizes`` has one row per source (``source``, ``source_size``). Sources in order of code points, null last, take
    ``weights`` in turn. What a stopped target leaves goes to the others by weight until none is above its stop. With
    sources in the order in which they would stop, the common level is the largest of the levels that remain after
    stopping the first k of them. One row per source throughout.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (rank - 1) % len(weights)).cast("long")
    everything = Window.partitionBy(F.lit(0))
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("stop", F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cap = F.col("source_size") * most
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    pull = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    return (
        sizes.withColumn("weight", weight).withColumn("stop", cap.cast("double") / F.col("weight"))
        .withColumn("level", left.cast("double") / pull)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def _order(doc_id: Column, size: Column) -> Column:
    """Place of a row in its source's shuffled order: a slice of a hash of id and size, the hash, id and size."""
    mark = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), size))
    return F.struct(
        (F.conv(F.substring(mark, 1, 6), 16, 10).cast("long") % SLICES).cast("int").alias("slice"), mark.alias("mark"),
        doc_id.alias("doc_id"), size.alias("size"),
    )


def mix(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """How often each document is taken into the mix: ``doc_id, source, size, source_size, target, times``.

    ``sized`` holds ``doc_id``, ``source`` and ``size`` (null: 0). Within a source documents are shuffled by a hash of
    id and size; a source whose target exceeds its size starts over, up to ``most`` times. A document's virtual finish
    time is the source's cumulative size up to it, divided by the source's target. All are ordered by finish time and
    taken while the cumulative size stays within the total. Rows with equal finish time come or stay out together, so
    equal rows get equal answers. The order depends on the rows only: reruns agree.

    No task sees a whole source: the running sums go over slices of the hash, and the cut over bins of virtual time.
    Sources pull at a constant rate, so bins of equal width hold about equal sizes. Only narrow rows are shuffled.
    """
    timed, cut = _timed(sized, weights, most)
    times = F.size(F.filter("finish", lambda v: v <= F.col("cut")))
    return timed.crossJoin(F.broadcast(cut)).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(times, F.lit(0)).cast("long").alias("times")
    )


def _timed(sized: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its place in its source's order and its finish times, and one row ``cut``: the last time that is taken."""
    rows = stored(
        sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        .select("*", _order(F.col("doc_id"), F.col("size")).alias("place")).select("*", "place.slice", "place.mark"),
        "mix-rows",
    )
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-goals")
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("source", "slice").agg(F.sum("size").alias("total"))
        .withColumn("offset", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
        .select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), "offset")
    )
    upto = (
        Window.partitionBy("source", "slice").orderBy("mark", "doc_id", "size")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = (
        rows.withColumn("upto", F.sum("size").over(upto))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
        .join(
            goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))
        )
    )
    rounds = F.sequence(F.lit(0), F.lit(most - 1))
    finish = F.transform(
        rounds, lambda e: (e * F.col("source_size") + F.col("offset") + F.col("upto")).cast("double") / F.col("target")
    )
    began = lambda v: v - F.col("size") / F.col("target")
    timed = stored(
        joined.withColumn("finish", F.when((F.col("target") > 0) & (F.col("size") > 0), finish))
        .select("doc_id", "source", "size", "source_size", "target", "place",
                F.coalesce(F.filter("finish", lambda v: began(v) < 1), F.array().cast("array<double>")).alias("finish")),
        "mix-times",
    )
    entries = timed.select("size", F.explode("finish").alias("v")).withColumn(
        "bin", F.floor(F.least("v", F.lit(2.0)) * BINS).cast("int")
    )
    ordered = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    bins = (
        entries.groupBy("bin").agg(F.sum("size").alias("total"), F.max("v").alias("last"))
        .withColumn("after", F.sum("total").over(ordered)).crossJoin(F.broadcast(budget))
    )
    # one row per bin; the bin in which the budget ends is cut row by row
    bins = stored(bins, "mix-bins")
    whole = bins.filter("after <= budget").agg(F.max("last").alias("v"))
    within = Window.partitionBy("bin").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    part = (
        entries.join(F.broadcast(bins.filter("after > budget and after - total < budget")), "bin")
        .withColumn("upto", F.col("after") - F.col("total") + F.sum("size").over(within))
        .filter("upto <= budget").agg(F.max("v").alias("v"))
    )
    return timed, whole.union(part).agg(F.max("v").alias("cut"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, columns as they were.

    A round through a source takes its shuffled order up to some place. Those places, at most ``most`` for each source, are all
    that the rows meet, so texts are not shuffled as long as the sources' table is small enough for Spark to broadcast.
    Rows that agree in id, source and size are taken equally often.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    with scratch(spark):
        timed, cut = _timed(sized, weights, most)
        taken = timed.crossJoin(F.broadcast(cut)).select(
            "source", "place", F.posexplode(F.filter("finish", lambda v: v <= F.col("cut"))).alias("round", "v")
        )
        ends = taken.groupBy("source", "round").agg(F.max("place").alias("end"))
        upto = stored(
            ends.groupBy("source").agg(F.collect_list("end").alias("__ends")).withColumnRenamed("source", "__source"),
            "mix-ends", keep=True,
        )
    size = word_count(F.col("text"))
    marked = docs.select("*", F.when(size > 0, _order(F.col("doc_id"), size)).alias("__place"))
    times = F.size(F.filter("__ends", lambda end: F.col("__place") <= end))
    return (
        marked.join(upto, F.col("source").eqNullSafe(F.col("__source")) & F.col("__place").isNotNull())
        .select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("__copy"))
        .drop("__copy")
    )
