"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphray.llm.store import stored

# Slices of the hash space in which the rows of a shard are numbered: fixed, so offsets stay small at any size.
SLICES = 4096


def _race(key: Column, shard: int, weight: float) -> Column:
    """Arrival time of ``shard`` for ``key``: exponential with rate ``weight``, so the earliest wins in proportion."""
    hashed = F.xxhash64(F.concat_ws("/", F.lit(str(shard)), key))
    uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.struct((-F.ln(uniform) / F.lit(float(weight))).alias("time"), F.lit(shard).alias("shard"))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that ``key`` belongs to.

    Depends on the key's text and the weights only. One more shard, or more weight for one, draws rows into that shard
    and moves no others. A null key is a key of its own. Shards of weight 0 get nothing.
    """
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    races = [_race(named, i, w) for i, w in enumerate(weights) if w > 0]
    if not races:
        raise ValueError("at least one shard needs a weight above 0")
    return (F.least(*races) if len(races) > 1 else races[0])["shard"]


def assign(df: DataFrame, key: Column, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row: no shuffle, any extra columns stay."""
    return df.withColumn(out, winner(key, weights))


def numbered(df: DataFrame, shard: str, out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in an order given by a hash of the row.

    ``df`` should be narrow: it is written once. Repeated rows are counted before any shuffle and numbered as a run, so
    neither a hot key nor many equal rows meet in one task; each shard is numbered in ``SLICES`` slices whose offsets
    come from a table of at most ``SLICES`` rows a shard, which is what gets broadcast.
    """
    columns = df.columns
    mark = F.xxhash64(*columns)
    runs = stored(
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__mark", mark).withColumn("__slice", F.pmod("__mark", F.lit(SLICES))),
        "shard-runs",
    )
    ahead = Window.partitionBy(shard).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        runs.groupBy(shard, "__slice").agg(F.sum("__n").alias("__total"))
        .select(shard, "__slice", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__offset"))
    )
    within = (
        Window.partitionBy(shard, "__slice").orderBy("__mark", *columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("__offset") + F.col("__before")
    return (
        runs.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
        .join(F.broadcast(offsets), [shard, "__slice"])
        .select(*columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(out))
    )
