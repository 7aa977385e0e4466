"""The time predicate shared by every panel query, and list arguments."""

import datetime as dt
import re

from pyspark.sql import functions as F

from quizlens.fixed_values import (
    BANDS, DEFAULT_PERIOD_DAYS, DEVICES, GRID_COLS, GRID_ROWS, LIST_LIMITS, WIDTH,
)

_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def _day(text):
    if not isinstance(text, str) or not _DAY.fullmatch(text):
        return None
    return dt.date.fromisoformat(text)      # a shape like 2024-13-45 raises ValueError


def period_filter(df, column, start=None, end=None, as_of=None):
    """Keep the rows of a period.

    ``start`` and ``end`` are ``YYYY-MM-DD``; the end day is included. With only
    ``start`` the period is open. Anything else, a lone ``end`` included, means
    the 30 days before ``as_of`` (now, when it is not given).

    The bounds are plain comparisons on the stored column so they reach the
    scan; a table laid out by day (a ``dt`` column) is also pruned by folder.
    """
    first, last = _day(start), _day(end)
    ts = F.col(column)
    by_day = "dt" in df.columns
    if first is None:
        kind = df.schema[column].dataType
        now = F.current_timestamp() if as_of is None else F.lit(as_of)
        edge = now.cast(kind) - F.expr(f"INTERVAL {DEFAULT_PERIOD_DAYS} DAYS")
        if by_day:
            df = df.filter(F.col("dt") >= edge.cast("date"))
        return df.filter(ts > edge)
    if by_day:
        df = df.filter(F.col("dt") >= F.lit(first))
    df = df.filter(ts >= F.lit(first))
    if last is None:
        return df
    if by_day:
        df = df.filter(F.col("dt") <= F.lit(last))
    return df.filter(ts < F.lit(last + dt.timedelta(days=1)))


def _leading_int(value):
    found = re.match(r"\s*([+-]?[0-9]+)", str(value if value is not None else ""))
    return int(found.group(1)) if found else 0


def _within(value, bounds):
    low, high, default = bounds
    return min(high, max(low, _leading_int(value) or default))


def list_args(screen, limit=None, offset=None):
    """Clamp the paging arguments of a request; text is read like a form field, and no limit is the screen's own."""
    return _within(limit, LIST_LIMITS[screen]), max(0, _leading_int(offset))


def paging(screen, limit=None, offset=None):
    """The paging arguments of a plan: clamped like a request's, but without a limit the list is whole."""
    most, skipped = list_args(screen, limit, offset)
    return None if limit is None else most, skipped


def top(rows, most=None):
    """All rows, or the first ``most``."""
    return rows if most is None else rows.limit(most)


def grid_args(cols=None, rows=None):
    return _within(cols, GRID_COLS), _within(rows, GRID_ROWS)


def click_args(device=None, band=None, section=None):
    """Optional heat-map filters; a value outside its list means no filter."""
    number = _leading_int(band)
    return (
        device if device in DEVICES else None,
        number if number in BANDS else None,
        str(section)[: WIDTH["section"]] if section else None,
    )
