"""Sales screen: who bought, who did not, and how much came in."""

from pyspark.sql import functions as F

from quizlens.fixed_values import DIRECT
from quizlens.functions import values as v
from quizlens.functions.period import paging, period_filter, top

ORDER_FILTERS = {
    "pagos": ["pago"],
    "pendentes": ["pendente"],
    "problema": ["estornado", "chargeback", "recusado", "cancelado"],
}


def _status(*names):
    return F.col("status").isin(*names)


def orders_summary(orders, **period):
    """Order counts by status and paid revenue; refunds leave the revenue."""
    counted = period_filter(orders, "created_at", **period).agg(
        v.rows().alias("pedidos"),
        v.count_where(_status("pago")).alias("pagos"),
        v.count_where(_status("pendente")).alias("pendentes"),
        v.count_where(_status("estornado", "chargeback")).alias("estornos"),
        v.count_where(_status("recusado", "cancelado")).alias("recusados"),
        v.count_where(_status("abandonado")).alias("abandonados"),
        v.sum_where(F.col("valor_cents"), _status("pago")).alias("receita_cents"),
        v.count_where(_status("pago") & F.col("session_id").isNull()).alias("pagos_sem_vinculo"),
    )
    return counted.withColumn(
        "ticket_cents", v.round_ratio(F.col("receita_cents"), F.col("pagos"))
    )


def checkout_summary(sessions, **period):
    went, bought = F.col("reached_checkout"), F.col("purchased")
    return period_filter(sessions, "first_ts", **period).agg(
        v.count_where(went).alias("checkouts"),
        v.count_where(bought).alias("compraram"),
        v.count_where(went & ~bought).alias("abandonaram"),
    )


def sales_by_day(orders, **period):
    return (
        period_filter(orders, "created_at", **period)
        .groupBy(v.day_key(F.col("created_at")).alias("dia"))
        .agg(
            v.count_where(_status("pago")).alias("pagos"),
            v.sum_where(F.col("valor_cents"), _status("pago")).alias("receita_cents"),
        )
        .orderBy("dia")
    )


def _purchases():
    return (
        v.count_where(F.col("purchased")).alias("compras"),
        v.sum_where(F.col("purchase_cents"), F.col("purchased")).alias("receita_cents"),
    )


def sales_by_band(sessions, **period):
    return (
        period_filter(sessions, "first_ts", **period)
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            v.rows().alias("sessoes"),
            v.count_where(F.col("reached_checkout")).alias("checkouts"),
            *_purchases(),
        )
        .orderBy("band")
    )


def sales_by_source(sessions, most=None, **period):
    return top((
        period_filter(sessions, "first_ts", **period)
        .groupBy(v.blank_to(F.col("utm_source"), DIRECT).alias("origem"))
        .agg(v.rows().alias("sessoes"), *_purchases())
        .orderBy(F.desc("receita_cents"), F.desc("sessoes"), "origem")
    ), most)


def order_filter(orders, filtro=None):
    """``pagos``, ``pendentes``, ``problema``; anything else keeps all orders."""
    wanted = ORDER_FILTERS.get(filtro)
    return orders if wanted is None else orders.filter(_status(*wanted))


def orders_with_session(orders, sessions):
    """Orders with what their visit knew; unlinked orders stay.

    Unlinked orders would all hash to one partition. They get a stand-in key of
    their own, with a character no session id has, so they spread evenly and
    match nothing.
    """
    visit = sessions.select(
        F.col("session_id").alias("_visit"), "score", "band", "device", "max_scroll",
        "duration_sec", F.col("utm_source").alias("_source"),
        F.col("utm_campaign").alias("_campaign"),
    )
    stand_in = F.concat(F.lit("#"), F.col("order_id"))
    keyed = orders.withColumn("_visit", F.coalesce("session_id", stand_in))
    return keyed.join(visit, "_visit", "left").select(
        "order_id", "session_id", "status", "evento", "valor_cents", "metodo", "produto",
        "cliente_nome", "cliente_email", "cliente_fone", "utm_source", "utm_campaign",
        "created_at", "paid_at", "score", "band", "device", "max_scroll", "duration_sec",
        F.coalesce("utm_source", "_source").alias("origem"),
        F.coalesce("utm_campaign", "_campaign").alias("campanha"),
    )


def order_list(orders, sessions, filtro=None, limit=None, **period):
    """The newest orders with their visit.

    The list is cut first: a visit adds columns to an order and never rows, so only
    the visits of listed orders are looked up. Their ids are broadcast when the list
    has a limit, and joined like any table when it has none.
    """
    limit, _ = paging("orders", limit)
    newest = [F.desc("created_at"), F.col("order_id")]
    listed = (
        period_filter(order_filter(orders, filtro), "created_at", **period)
        .orderBy(*newest)
    )
    listed = top(listed, limit)
    ids = listed.select("session_id").filter(F.col("session_id").isNotNull()).distinct()
    visits = sessions.join(ids if limit is None else F.broadcast(ids), "session_id", "left_semi")
    return orders_with_session(listed, visits).orderBy(*newest)


def rescue_list(sessions, most=None, **period):
    """Visits that went to the checkout and did not buy, reachable ones first."""
    return top((
        period_filter(sessions, "first_ts", **period)
        .filter(F.col("reached_checkout") & ~F.col("purchased"))
        .orderBy(F.desc("contact"), F.desc("first_ts"), "session_id")
        .select(
            "session_id", "first_ts", "device", "score", "band", "contact", "max_scroll",
            "duration_sec", "cta_clicks", "utm_source", "utm_campaign",
        )
    ), most)
