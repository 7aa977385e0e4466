"""Pages of long lists, with the total and whether more follow.

A page deep in a list would sort all rows before it. Instead the rows are counted by day, and those of the
page's first days by minute, and only the minutes that hold the page are sorted. Of a table by day only the
page's days are read for it.
"""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.functions.period import paging, period_filter
from quizlens.plans.log import event_log_filter
from quizlens.plans.sales import order_filter, orders_with_session
from quizlens.plans.visits import SESSION_LIST, session_filter

STEPS = {"day": dt.timedelta(days=1), "minute": dt.timedelta(minutes=1)}


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    has_more: bool

    def with_numbers(self):
        """The rows with ``total`` and ``tem_mais`` beside each."""
        return self.rows.withColumns({"total": F.lit(self.total).cast("int"), "tem_mais": F.lit(self.has_more)})


def _stretch(counts, skip, most):
    """Of ``(moment, rows)`` from new to old: the first and last moment of a page, and what to skip of them."""
    first, held = None, 0
    for moment, n in counts:
        if first is None and skip >= n:
            skip -= n
            continue
        first = first or moment
        held += n
        if held >= skip + most:
            return first, moment, skip
    return (first, counts[-1][0], skip) if first else (None, None, skip)


def _narrowed(rows, ts, unit, skip, most):
    """``rows`` of the days or minutes that hold the page, what is to skip of them, and how many rows there were."""
    counts = rows.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("moment")).count()
    counts = [(r["moment"], r["count"]) for r in counts.orderBy(F.desc("moment")).collect()]    # a row a day, or a minute
    total = sum(n for _, n in counts)
    newest, oldest, skip = _stretch(counts, skip, most)
    if newest is None:
        return rows.limit(0), 0, total
    kind = rows.schema[ts].dataType
    low, high = F.lit(oldest).cast(kind), F.lit(newest + STEPS[unit]).cast(kind)
    rows = rows.where((F.col(ts) >= low) & (F.col(ts) < high))
    if unit == "day" and "dt" in rows.columns:
        rows = rows.where(F.col("dt").between(F.lit(oldest.date()), F.lit(newest.date())))
    return rows, skip, total


def page(rows, ts, then, limit, offset) -> Page:
    """Rows ``offset`` to ``offset + limit`` of ``rows``, newest first and then by the columns ``then``."""
    near, skip, total = _narrowed(rows, ts, "day", offset, limit)
    if offset < total:
        near, skip, _ = _narrowed(near, ts, "minute", skip, limit)
    return Page(near.orderBy(F.desc(ts), *then).offset(skip).limit(limit), total, offset + limit < total)


def _request(screen, limit, offset):
    limit, offset = paging(screen, "" if limit is None else limit, offset)
    return limit, offset


def event_page(events, name=None, session=None, limit=None, offset=None, **period) -> Page:
    """A page of the event log; without a limit it has the screen's own length."""
    chosen = event_log_filter(period_filter(events, "ts", **period), name, session)
    found = page(chosen, "ts", [F.desc("id")], *_request("events", limit, offset))
    columns = ["id", "session_id", "event_name", "step_index", "section", "label", "device", "ts"]
    return Page(found.rows.select(columns), found.total, found.has_more)


def session_page(sessions, filtro=None, device=None, limit=None, offset=None, **period) -> Page:
    """A page of the visits."""
    chosen = session_filter(period_filter(sessions, "first_ts", **period), filtro, device)
    found = page(chosen, "first_ts", ["session_id"], *_request("sessions", limit, offset))
    return Page(found.rows.select(SESSION_LIST), found.total, found.has_more)


def order_page(orders, sessions, filtro=None, limit=None, offset=None, **period) -> Page:
    """A page of the orders with what their visits knew; only the visits of the page are looked up."""
    chosen = order_filter(period_filter(orders, "created_at", **period), filtro)
    found = page(chosen, "created_at", ["order_id"], *_request("orders", limit, offset))
    ids = found.rows.select("session_id").where("session_id IS NOT NULL").distinct()
    visits = sessions.join(F.broadcast(ids), "session_id", "left_semi")     # no more than the page's rows
    return Page(orders_with_session(found.rows, visits), found.total, found.has_more)
