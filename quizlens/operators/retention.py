"""Keeping tables within their age limits and old files within today's schema."""

from pyspark.sql import functions as F

from quizlens.fixed_values import KEEP_CALLS_HOURS, KEEP_LOG_DAYS, KEEP_SESSION_DAYS


def _edge(df, column, as_of, amount, unit):
    kind = df.schema[column].dataType
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    return now.cast(kind) - F.expr(f"INTERVAL {amount} {unit}")


def _age_rules(as_of):
    """Table name -> condition a row must meet to stay. Orders always stay."""
    recent = lambda column, amount, unit: (
        lambda df: F.col(column) >= _edge(df, column, as_of, amount, unit)
    )
    old_visit = recent("first_ts", KEEP_SESSION_DAYS, "DAYS")
    return {
        "events": recent("ts", KEEP_LOG_DAYS, "DAYS"),
        "clicks": recent("ts", KEEP_LOG_DAYS, "DAYS"),
        "sessions": lambda df: old_visit(df) | F.col("purchased"),
        "calls": recent("ts", KEEP_CALLS_HOURS, "HOURS"),
        "orders": lambda df: F.lit(True),
    }


def retained(table, df, as_of=None):
    """The rows of a table that are young enough to keep.

    A table laid out by day should drop whole ``dt`` folders instead; this is
    the exact rule for what is left inside the oldest one.
    """
    return df.filter(_age_rules(as_of)[table](df))


def retention_summary(tables, as_of=None):
    """Kept and dropped rows per table, for ``tables`` a dict of name -> DataFrame."""
    rules = _age_rules(as_of)
    parts = []
    for name, df in tables.items():
        kept = F.count_if(rules[name](df))
        parts.append(df.agg(
            F.lit(name).alias("table"), kept.alias("kept"),
            (F.count(F.lit(1)) - kept).alias("dropped"),
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def evolve_sessions(older, current):
    """Session files from before the purchase mirror, read together with current ones."""
    return older.unionByName(current, allowMissingColumns=True).withColumn(
        "purchased", F.coalesce("purchased", F.lit(False))
    )
