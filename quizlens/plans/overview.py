"""Overview screen: headline numbers and cuts by day, device and source."""

from pyspark.sql import functions as F

from quizlens.fixed_values import DASH, DIRECT, NO_DEVICE
from quizlens.functions import values as v
from quizlens.functions.period import period_filter, top


def _visits(sessions, period):
    return period_filter(sessions, "first_ts", **period)


def overview_summary(sessions, **period):
    """One row of headline numbers.

    The median keeps one counter per distinct duration; durations are clamped
    at ingest, so that is at most 86 401 counters however many visits there are.
    """
    result = F.col("reached_result")
    return _visits(sessions, period).agg(
        v.rows().alias("sessoes"),
        v.count_where(F.col("max_q") > 0).alias("comecaram"),
        v.count_where(F.col("max_q") >= 10).alias("terminaram"),
        v.count_where(F.col("contact")).alias("contatos"),
        v.count_where(result).alias("viram_oferta"),
        v.count_where(F.col("cta_clicks") > 0).alias("com_cta"),
        v.count_where(F.col("reached_checkout")).alias("checkouts"),
        v.count_where(F.col("purchased")).alias("compras"),
        v.sum_where(F.col("purchase_cents"), F.col("purchased")).alias("receita_cents"),
        v.count_where(F.col("max_q") == 0).alias("saiu_na_cara"),
        v.mean1(F.sum("score"), F.count("score")).alias("nota_media"),
        v.mean1(F.sum("duration_sec"), F.count("duration_sec")).alias("tempo_medio"),
        v.mean1(F.sum(F.when(result, F.col("max_scroll"))), F.count_if(result))
        .alias("scroll_oferta"),
        F.coalesce(F.percentile("duration_sec", F.lit(0.5)), F.lit(0.0)).alias("tempo_mediano"),
    )


def overview_by_day(sessions, **period):
    return (
        _visits(sessions, period)
        .groupBy(v.day_key(F.col("first_ts")).alias("dia"))
        .agg(
            v.rows().alias("sessoes"),
            v.count_where(F.col("max_q") >= 10).alias("terminaram"),
            v.count_where(F.col("reached_result")).alias("ofertas"),
            v.count_where(F.col("reached_checkout")).alias("checkouts"),
        )
        .orderBy("dia")
    )


def overview_by_device(sessions, **period):
    return (
        _visits(sessions, period)
        .groupBy(F.coalesce("device", F.lit(NO_DEVICE)).alias("device"))
        .agg(
            v.rows().alias("sessoes"),
            v.count_where(F.col("max_q") >= 10).alias("terminaram"),
            v.count_where(F.col("reached_checkout")).alias("checkouts"),
            v.mean1(F.sum("duration_sec"), F.count("duration_sec")).alias("tempo_medio"),
        )
        .orderBy(F.desc("sessoes"), "device")
    )


def overview_by_source(sessions, most=None, **period):
    return top((
        _visits(sessions, period)
        .groupBy(
            v.blank_to(F.col("utm_source"), DIRECT).alias("origem"),
            v.blank_to(F.col("utm_campaign"), DASH).alias("campanha"),
        )
        .agg(
            v.rows().alias("sessoes"),
            v.count_where(F.col("max_q") >= 10).alias("terminaram"),
            v.count_where(F.col("reached_checkout")).alias("checkouts"),
        )
        .orderBy(F.desc("sessoes"), "origem", "campanha")
    ), most)
