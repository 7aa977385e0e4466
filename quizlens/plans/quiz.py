"""Questions screen: how the quiz itself performs."""

from pyspark.sql import functions as F

from quizlens.functions import values as v
from quizlens.functions.period import period_filter


def question_accuracy(events, **period):
    """Answers, hits and misses per question, in question order.

    An answer with a topic is logged twice, so answers may exceed hits + misses.
    """
    answered = (F.col("event_name") == "quiz_answer") & F.col("section").isNotNull()
    return (
        period_filter(events, "ts", **period)
        .filter(answered)
        .groupBy("section")
        .agg(
            v.rows().alias("respostas"),
            v.count_where(F.col("label") == "hit").alias("acertos"),
            v.count_where(F.col("label") == "miss").alias("erros"),
        )
        .orderBy(v.question_number(F.col("section")).asc_nulls_last(), "section")
    )


def quiz_dropoff(sessions, **period):
    """Visits by the last question they answered, unfinished ones only."""
    return (
        period_filter(sessions, "first_ts", **period)
        .filter(F.col("max_q") < 10)
        .groupBy("max_q")
        .agg(v.rows().alias("sessoes"))
        .orderBy("max_q")
    )


def _by_result(sessions, column, period, *more):
    return (
        period_filter(sessions, "first_ts", **period)
        .filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            v.rows().alias("sessoes"),
            v.count_where(F.col("cta_clicks") > 0).alias("ctas"),
            v.count_where(F.col("reached_checkout")).alias("checkouts"),
            *more,
        )
        .orderBy(column)
    )


def score_distribution(sessions, **period):
    return _by_result(sessions, "score", period)


def band_distribution(sessions, **period):
    scroll = v.mean1(F.sum("max_scroll"), F.count("max_scroll")).alias("scroll_medio")
    return _by_result(sessions, "band", period, scroll)
