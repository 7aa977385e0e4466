"""Events screen: the raw log and a summary by type."""

from pyspark.sql import functions as F

from quizlens.fixed_values import WIDTH
from quizlens.functions import values as v
from quizlens.functions.period import paging, period_filter, top


def event_log_filter(events, name=None, session=None):
    if name:
        events = events.filter(F.col("event_name") == str(name)[: WIDTH["event_name"]])
    if session:
        events = events.filter(F.col("session_id") == str(session)[: WIDTH["session_id"]])
    return events


def events_by_type(events, **period):
    """Volume per event name; the name and visit filters of the log do not apply."""
    return (
        period_filter(events, "ts", **period)
        .groupBy("event_name")
        .agg(
            v.rows().alias("n"),
            v.distinct("session_id").alias("sessoes"),
            F.max("ts").alias("ultimo"),
        )
        .orderBy(F.desc("n"), "event_name")
    )


def event_count(events, name=None, session=None, **period):
    chosen = event_log_filter(period_filter(events, "ts", **period), name, session)
    return chosen.agg(v.rows().alias("n"))


def event_log(events, name=None, session=None, limit=None, offset=None, after=None, **period):
    """Newest events first. Deep pages should pass ``after``, the (ts, id) of the
    last row seen, instead of an offset."""
    limit, offset = paging("events", limit, offset)
    chosen = event_log_filter(period_filter(events, "ts", **period), name, session)
    if after is not None:
        ts, last_id = F.lit(after[0]).cast(events.schema["ts"].dataType), F.lit(after[1])
        chosen = chosen.filter((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < last_id)))
    paged = chosen.orderBy(F.desc("ts"), F.desc("id")).offset(offset)
    return (
        top(paged, limit)
        .select("id", "session_id", "event_name", "step_index", "section", "label", "device", "ts")
    )
