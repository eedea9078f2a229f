"""Ordered analytics (carry forward, running sum, lead/lag, numbering) that survive hot keys.

A plain window over ``partitionBy(key)`` sends a key that holds a third of all rows to one task.
Here every key is cut into consecutive buckets (a time slot, a block of line numbers). A partially
aggregated summary, one row per key and bucket, is scanned with a small window; its result is joined
back and the remaining work is a window over (key, bucket). No task ever sees a whole hot key, only
its bucket summaries. ``bucket`` must grow with the ordering columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__part"
CARRY = "__carry"


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(o) for o in order])


def _scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    uses: Sequence[str],
    summary: Column,
    carry,
    local,
    out: str,
) -> DataFrame:
    """Shared two-step shape: ``carry(window)`` over summaries, ``local(window, carry)`` per bucket.

    Keys and bucket form one struct: it is never null, so null keys meet in the join, and join and
    window agree on one partitioning. When ``df`` holds nothing but keys, order and ``uses``, summary
    and rows read one and the same exchange, so the input is computed once; a wider ``df`` gets its
    summary from a second, column-pruned pass that combines before it shuffles.
    """
    part = F.struct(*keys, bucket.alias("bucket")).alias(PART)
    narrow = list(dict.fromkeys([*order, *uses]))
    one_pass = set(df.columns) <= {*keys, *narrow}
    if one_pass:
        cut = df.select(part, *[c for c in narrow if c not in keys]).repartition(PART)
    else:
        cut = df.select("*", part)
    # buckets alone order the summaries; the order columns come along so that both uses of ``cut``
    # need the same columns, which is what lets Spark reuse the exchange
    ends = {f"__end{i}": F.max(o) for i, o in enumerate(order)}
    across = Window.partitionBy(*[F.col(PART)[k] for k in keys]).orderBy(F.col(PART)["bucket"], *ends)
    carried = (
        cut.groupBy(PART)
        .agg(summary.alias("__sum"), *[e.alias(n) for n, e in ends.items()])
        .select(PART, carry(across).alias(CARRY))
    )
    within = Window.partitionBy(PART).orderBy(*order)
    joined = cut.join(carried, PART, "left").withColumn(out, local(within, F.col(CARRY)))
    if one_pass:
        joined = joined.withColumns({k: F.col(PART)[k] for k in keys})
    return joined.select(*df.columns, out)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_known(df, keys, order, bucket, value: str, out: str) -> DataFrame:
    """Latest non-null ``value`` up to and including the row."""
    latest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), _order_key(order)))
    return _scan(
        df, keys, order, bucket, [value], latest,
        lambda w: F.last("__sum", ignorenulls=True).over(_before(w)),
        lambda w, c: F.coalesce(F.last(value, ignorenulls=True).over(_so_far(w)), c),
        out,
    )


def running_sum(df, keys, order, bucket, amount: Column, uses: Sequence[str], out: str) -> DataFrame:
    """Sum of ``amount`` (an expression over the columns ``uses``) up to and including the row."""
    return _scan(
        df, keys, order, bucket, uses, F.sum(amount),
        lambda w: F.coalesce(F.sum("__sum").over(_before(w)), F.lit(0)),
        lambda w, c: c + F.coalesce(F.sum(amount).over(_so_far(w)), F.lit(0)),
        out,
    )


def numbered(df, keys, order, bucket, out: str) -> DataFrame:
    """Position of the row within its key, from 1."""
    return _scan(
        df, keys, order, bucket, [], F.count(F.lit(1)),
        lambda w: F.coalesce(F.sum("__sum").over(_before(w)), F.lit(0)),
        lambda w, c: c + F.row_number().over(w),
        out,
    )


def next_value(df, keys, order, bucket, value: Column, uses: Sequence[str], out: str) -> DataFrame:
    """``value`` of the following row, null at the end of the key."""
    boxed = F.struct(value.alias("v"))
    return _scan(
        df, keys, order, bucket, uses, F.min_by(boxed, _order_key(order)),
        lambda w: F.lead("__sum").over(w),
        lambda w, c: F.coalesce(F.lead(boxed).over(w), c)["v"],
        out,
    )


def previous_value(df, keys, order, bucket, value: Column, uses: Sequence[str], out: str) -> DataFrame:
    """``value`` of the preceding row, null at the start of the key."""
    boxed = F.struct(value.alias("v"))
    return _scan(
        df, keys, order, bucket, uses, F.max_by(boxed, _order_key(order)),
        lambda w: F.lag("__sum").over(w),
        lambda w, c: F.coalesce(F.lag(boxed).over(w), c)["v"],
        out,
    )


def block(col: str, size: int) -> Column:
    """Bucket for an integer ordering column."""
    return F.floor(F.col(col) / size)


def time_slot(ts: str, seconds: int) -> Column:
    """Bucket for a timestamp ordering column."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
