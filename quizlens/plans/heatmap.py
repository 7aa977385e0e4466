"""Heat-map screen: where visitors click and how far they scroll."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quizlens.fixed_values import DASH, DEAD_LABEL, NO_LABEL
from quizlens.functions import values as v
from quizlens.functions.period import click_args, grid_args, period_filter, top


def click_filter(clicks, device=None, band=None, section=None):
    """Optional cuts by device, result band and block; odd values mean no cut."""
    device, band, section = click_args(device, band, section)
    for name, value in (("device", device), ("band", band), ("section", section)):
        if value is not None:
            clicks = clicks.filter(F.col(name) == value)
    return clicks


def _selected(clicks, cuts, period):
    return period_filter(click_filter(clicks, **cuts), "ts", **period)


def heat_grid(clicks, cols=None, rows=None, cuts=None, most=None, **period):
    """Clicks per cell of a grid over the page, the busiest first; all of them, or the first ``most``.

    The grid has at most 120 x 400 cells, so a task sends at most that many
    partial counts to the shuffle.
    """
    cols, rows = grid_args(cols, rows)
    cells = (
        _selected(clicks, cuts or {}, period)
        .groupBy(
            v.grid_cell(F.col("x_pct"), cols).alias("gx"),
            v.grid_cell(F.col("y_pct"), rows).alias("gy"),
        )
        .agg(
            v.rows().alias("n"),
            v.count_where(F.col("is_cta")).alias("n_cta"),
            v.count_where(F.col("dead")).alias("n_mortos"),
        )
        .orderBy(F.desc("n"), "gx", "gy")
    )
    return top(cells, most)


def heat_totals(grid):
    """Peak and total over the cells: all clicks of the period if the grid is whole."""
    return grid.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("pico"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
    )


def heat_intensity(grid):
    """Each cell's share of the peak; the window spans one grid, at most 120 x 400 cells."""
    peak = F.max("n").over(Window.partitionBy())
    return grid.select("gx", "gy", "n", (F.col("n") / peak).alias("intensity")).orderBy(
        F.desc("n"), "gx", "gy"
    )


def element_ranking(clicks, cuts=None, most=None, **period):
    return top((
        _selected(clicks, cuts or {}, period)
        .groupBy(
            F.coalesce("label", F.lit(NO_LABEL)).alias("label"),
            F.coalesce("section", F.lit(DASH)).alias("section"),
        )
        .agg(
            v.rows().alias("cliques"),
            v.distinct("session_id").alias("sessoes"),
            F.bool_or("is_cta").alias("is_cta"),
        )
        .orderBy(F.desc("cliques"), "label", "section")
    ), most)


def dead_clicks(clicks, cuts=None, most=None, **period):
    """Clicks on things that look like buttons and are not."""
    return top((
        _selected(clicks, cuts or {}, period)
        .filter("dead")
        .groupBy(
            F.coalesce("section", F.lit(DASH)).alias("section"),
            F.coalesce("label", F.lit(DEAD_LABEL)).alias("label"),
        )
        .agg(v.rows().alias("cliques"), v.distinct("session_id").alias("sessoes"))
        .orderBy(F.desc("cliques"), "section", "label")
    ), most)


def clicks_by_section(clicks, cuts=None, **period):
    return (
        _selected(clicks, cuts or {}, period)
        .groupBy(F.coalesce("section", F.lit(DASH)).alias("section"))
        .agg(
            v.rows().alias("cliques"),
            v.count_where(F.col("is_cta")).alias("cta"),
            v.count_where(F.col("dead")).alias("mortos"),
            v.distinct("session_id").alias("sessoes"),
        )
        .orderBy(F.desc("cliques"), "section")
    )


def scroll_curve(sessions, device=None, band=None, **period):
    """Visits that reached the result, by how far they scrolled at least.

    Ten conditional counts in one pass; visits are never multiplied by the ten
    thresholds. The block cut of the click queries does not apply here.
    """
    counts = ", ".join(f"cast(count_if(max_scroll >= {m}) AS int)" for m in range(10, 101, 10))
    reached = click_filter(
        period_filter(sessions, "first_ts", **period).filter("reached_result"), device, band
    )
    counted = reached.agg(
        v.rows().alias("total"),
        F.expr(f"array({counts})").alias("counts"),
    )
    return (
        counted.select("total", F.posexplode("counts").alias("pos", "sessoes"))
        .select(
            ((F.col("pos") + 1) * 10).alias("ate"), "sessoes",
            v.pct1(F.col("sessoes"), F.col("total")).alias("pct"),
        )
        .orderBy("ate")
    )
