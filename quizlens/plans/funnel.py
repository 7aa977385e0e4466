"""Funnel screen: how far visits go, and where they stop."""

from pyspark.sql import functions as F

from quizlens.fixed_values import CTA_LABEL, DASH, FUNNEL_STEPS, NO_SECTION
from quizlens.functions import values as v
from quizlens.functions.period import period_filter, top


def funnel_top_step(events, **period):
    """Visits by the highest step they reached.

    The period limits events, not visits: a visit counts by what it did inside
    the period, and any event at all places it at step 0 or later.
    """
    return (
        period_filter(events, "ts", **period)
        .groupBy("session_id")
        .agg(F.max("step_index").alias("topo"))
        .groupBy("topo")
        .agg(v.rows().alias("sessoes"))
        .orderBy("topo")
    )


def _steps():
    """The step dimension, one row per step."""
    rows = ", ".join(
        f"named_struct('step', {i}, 'key', '{key}', 'label', '{label}')"
        for i, (key, label) in enumerate(FUNNEL_STEPS)
    )
    return F.expr(f"inline(array({rows}))")


def _per_step(events, period):
    """Nine rows, visits whose top is exactly / at least that step.

    One aggregation over visits gives all eighteen numbers in a single row,
    which is then unfolded: the steps nobody reached come out as 0 and no join
    or global sort is needed.
    """
    tops = (
        period_filter(events, "ts", **period)
        .groupBy("session_id")
        .agg(F.max("step_index").alias("topo"))
    )
    def counts(comparison):
        each = [f"cast(count_if(topo {comparison} {i}) AS int)" for i in range(len(FUNNEL_STEPS))]
        return F.expr(f"array({', '.join(each)})")

    counted = tops.agg(counts("=").alias("exact"), counts(">=").alias("reached"))
    return counted.select("exact", "reached", _steps()).select(
        "key", "step", "label",
        F.get("exact", F.col("step")).alias("no_topo"),
        F.get("reached", F.col("step")).alias("sessoes"),
        F.get("reached", F.lit(0)).alias("_first"),
        F.get("reached", F.col("step") - 1).alias("_before"),
    )


def funnel_zero_fill(events, **period):
    """All steps with the visits that stopped there; empty steps show 0."""
    return _per_step(events, period).select("step", "key", F.col("no_topo").alias("sessoes"))


def funnel_cumulative(events, **period):
    """Visits that reached at least each step."""
    return _per_step(events, period).select("step", "sessoes")


def funnel_drop(events, **period):
    """Visits lost before each step, and the share kept; none for the first step."""
    return funnel_steps(events, **period).select("step", "perdeu", "pct_do_anterior")


def funnel_steps(events, **period):
    """The cumulative funnel with its shares and losses."""
    before = F.col("_before")
    return (
        _per_step(events, period)
        .select(
            "key", "step", "label", "sessoes",
            v.pct1(F.col("sessoes"), F.col("_first")).alias("pct_do_topo"),
            F.when(before.isNotNull(), F.greatest(F.lit(0), before - F.col("sessoes")))
            .alias("perdeu"),
            F.when(before.isNotNull(), v.pct1(F.col("sessoes"), before)).alias("pct_do_anterior"),
        )
        .orderBy("step")
    )


def bottleneck(events, **period):
    """The step with the largest loss; the earliest one on a tie."""
    return (
        funnel_steps(events, **period)
        .filter(F.col("perdeu").isNotNull())
        .orderBy(F.desc("perdeu"), "step")
        .limit(1)
        .select("key", "step", "perdeu")
    )


def section_reach(events, **period):
    """Visits that saw each block of the offer."""
    seen = (F.col("event_name") == "section_view") & F.col("section").isNotNull()
    return (
        period_filter(events, "ts", **period)
        .filter(seen)
        .groupBy("section")
        .agg(v.distinct("session_id").alias("sessoes"))
        .orderBy(F.desc("sessoes"), "section")
    )


def offer_abandonment(sessions, most=None, **period):
    """Where visits that saw the result and left without the checkout had stopped."""
    return top((
        period_filter(sessions, "first_ts", **period)
        .filter(F.col("reached_result") & ~F.col("reached_checkout"))
        .groupBy(F.coalesce("last_section", F.lit(NO_SECTION)).alias("section"))
        .agg(v.rows().alias("sessoes"))
        .orderBy(F.desc("sessoes"), "section")
    ), most)


def cta_ranking(events, most=None, **period):
    """Which buying button works: clicks and visits by block and label."""
    return top((
        period_filter(events, "ts", **period)
        .filter(F.col("event_name").isin("cta_click", "checkout_click"))
        .groupBy(
            F.coalesce("section", F.lit(DASH)).alias("section"),
            F.coalesce("label", F.lit(CTA_LABEL)).alias("label"),
        )
        .agg(v.rows().alias("cliques"), v.distinct("session_id").alias("sessoes"))
        .orderBy(F.desc("cliques"), "section", "label")
    ), most)


def capture_outcome(events, **period):
    """Visits that left a contact and visits that skipped it."""
    return (
        period_filter(events, "ts", **period)
        .filter(F.col("event_name").isin("capture_submit", "capture_skip"))
        .groupBy("event_name")
        .agg(v.distinct("session_id").alias("sessoes"))
        .orderBy("event_name")
    )
