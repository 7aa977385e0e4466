"""Ordered computations that do not put one key's whole history in one task.

A key may hold a large share of all rows, so a plain window over the key would
run in a single task. Here a key is split into *pieces* of time. The window
runs inside (key, piece); what crosses a piece boundary is carried by a small
summary with one row per (key, piece), whose own window per key is bounded by
the number of pieces on the time axis and not by the number of rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def piece_of(micros, width=MINUTE):
    """Start of the piece of time a moment falls in."""
    return micros - F.pmod(micros, F.lit(width))


def _whole(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def _carry(df, summary, keys):
    return df.join(summary, [*keys, "piece"], "left")


def last_known(df, keys, order, value, out):
    """Add ``out``: the latest non-NULL ``value`` at or before each row of its key.

    ``df`` needs a ``piece`` column.
    """
    inside = _whole([*keys, "piece"], order).rowsBetween(Window.unboundedPreceding, 0)
    before = _whole(keys, ["piece"]).rowsBetween(Window.unboundedPreceding, -1)
    moment = F.when(F.col(value).isNotNull(), F.struct(*order))
    summary = (
        df.groupBy(*keys, "piece")
        .agg(F.max_by(F.col(value), moment).alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        .select(*keys, "piece", "_carry")
    )
    return (
        _carry(df.withColumn(out, F.last(value, ignorenulls=True).over(inside)), summary, keys)
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_carry")
    )


def running_sum(df, keys, order, delta, out):
    """Add ``out``: sum of ``delta`` over the key up to each row, ties included.

    ``df`` needs a ``piece`` column, and rows that tie must share a piece.
    """
    inside = _whole([*keys, "piece"], order).rangeBetween(Window.unboundedPreceding, 0)
    before = _whole(keys, ["piece"]).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        df.groupBy(*keys, "piece")
        .agg(F.sum(delta).alias("_part"))
        .withColumn("_carry", F.sum("_part").over(before))
        .select(*keys, "piece", "_carry")
    )
    return (
        _carry(df.withColumn(out, F.sum(delta).over(inside)), summary, keys)
        .withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0)))
        .drop("_carry")
    )
