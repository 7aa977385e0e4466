"""Sessions screen: the list of visits and the journey of each."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quizlens.fixed_values import DEVICES, WIDTH
from quizlens.functions import values as v
from quizlens.functions.period import paging, period_filter, top

SESSION_LIST = [
    "session_id", "first_ts", "device", "max_q", "score", "band", "contact", "reached_result",
    "max_scroll", "last_section", "duration_sec", "cta_clicks", "reached_checkout",
    "utm_source", "utm_campaign", "country", "referrer", "purchased", "purchase_cents",
]

def _c(name):
    return F.col(name)


# behaviour filters of the list: name -> condition, made when a session is there
SESSION_FILTERS = {
    "comprou": lambda: _c("purchased"),
    "nao-comprou": lambda: _c("reached_checkout") & ~_c("purchased"),
    "checkout": lambda: _c("reached_checkout"),
    "cta": lambda: (_c("cta_clicks") > 0) & ~_c("reached_checkout"),
    "oferta": lambda: _c("reached_result") & (_c("cta_clicks") == 0),
    "largou": lambda: _c("max_q").between(1, 9),
    "na-cara": lambda: _c("max_q") == 0,
    "contato": lambda: _c("contact"),
}


def session_filter(sessions, filtro=None, device=None):
    """One behaviour filter, unknown names keeping all, and an optional device."""
    if filtro in SESSION_FILTERS:
        sessions = sessions.filter(SESSION_FILTERS[filtro]())
    if device in DEVICES:
        sessions = sessions.filter(F.col("device") == device)
    return sessions


def session_count(sessions, filtro=None, device=None, **period):
    chosen = session_filter(period_filter(sessions, "first_ts", **period), filtro, device)
    return chosen.agg(v.rows().alias("n"))


def session_list(sessions, filtro=None, device=None, limit=None, offset=None, after=None, **period):
    """Newest visits first. Deep pages should pass ``after``, the (first_ts, session_id) of the
    last row seen, instead of an offset."""
    limit, offset = paging("sessions", limit, offset)
    chosen = session_filter(period_filter(sessions, "first_ts", **period), filtro, device)
    if after is not None:
        ts, last_id = F.lit(after[0]).cast(sessions.schema["first_ts"].dataType), F.lit(after[1])
        chosen = chosen.filter(
            (F.col("first_ts") < ts) | ((F.col("first_ts") == ts) & (F.col("session_id") > last_id))
        )
    return top(chosen.orderBy(F.desc("first_ts"), "session_id").offset(offset), limit).select(*SESSION_LIST)


def _journey_rows(df, kind, ts, order, most, paid, **columns):
    empty = {
        "section": "string", "label": "string", "step_index": "int", "x_pct": "double", "y_pct": "double",
        "is_cta": "boolean", "status": "string", "valor_cents": "int", "metodo": "string", "produto": "string",
        "cliente_nome": "string", "cliente_email": "string", "paid_at": paid,
    }
    filled = {n: F.lit(None).cast(t) for n, t in empty.items()} | columns
    filled = {n: filled[n].cast(t) for n, t in empty.items()} | {"name": filled["name"]}
    time_order = Window.partitionBy("session_id").orderBy(ts, *order)
    placed = df.withColumn("pos", F.row_number().over(time_order))
    if most is not None:
        # Spark keeps only the first rows of each visit before the shuffle, so a very
        # busy visit does not travel whole
        placed = placed.filter(F.col("pos") <= most)
    return placed.select(
        "session_id", F.col(ts).alias("ts"), F.lit(kind).alias("kind"),
        *[column.alias(name) for name, column in filled.items()], "pos",
    )


def session_journey(events, clicks, orders, sessions, ids=None, most=None):
    """Timelines: the events, clicks and orders of each visit, in time order.

    ``ids`` is an optional DataFrame of visits to show; ``most`` the rows of each
    kind to show per visit (such as ``JOURNEY_LIMITS``), by default all. Visits
    without a session row have no journey.
    """
    most, paid = most or {}, orders.schema["paid_at"].dataType.simpleString()
    known = sessions.select("session_id")
    if ids is not None:
        chosen = ids.select(v.cut(F.col("session_id"), WIDTH["session_id"]).alias("session_id"))
        known = known.join(chosen, "session_id", "left_semi")
    parts = [
        _journey_rows(
            events, "event", "ts", ["id"], most.get("event"), paid, name=F.col("event_name"),
            section=F.col("section"), label=F.col("label"), step_index=F.col("step_index"),
        ),
        _journey_rows(
            clicks, "click", "ts", ["id"], most.get("click"), paid,
            name=F.when(F.col("dead"), "dead").otherwise("click"),
            section=F.col("section"), label=F.col("label"),
            x_pct=F.col("x_pct"), y_pct=F.col("y_pct"), is_cta=F.col("is_cta"),
        ),
        _journey_rows(
            orders.filter(F.col("session_id").isNotNull()), "order", "created_at", ["order_id"],
            most.get("order"), paid, name=F.col("order_id"),
            **{n: F.col(n) for n in ("status", "valor_cents", "metodo", "produto", "cliente_nome", "cliente_email", "paid_at")},
        ),
    ]
    shown = [part.join(known, "session_id", "left_semi") for part in parts]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def journey_of(tables, session_id, most=None):
    """The journey of one visit as its four parts, oldest rows first; all rows, or the first ``most`` of a kind."""
    wanted = str(session_id)[: WIDTH["session_id"]]
    own = lambda df: df.filter(F.col("session_id") == wanted)
    cut = lambda kind, rows: top(rows, (most or {}).get(kind))
    return {
        "sessao": own(tables.sessions),
        "eventos": cut("event", own(tables.events).orderBy("ts", "id"))
        .select("event_name", "step_index", "section", "label", "ts"),
        "cliques": cut("click", own(tables.clicks).orderBy("ts", "id"))
        .select("section", "label", "x_pct", "y_pct", "is_cta", "dead", "ts"),
        "pedidos": cut("order", own(tables.orders).orderBy("created_at", "order_id"))
        .select("order_id", "status", "valor_cents", "metodo", "produto", "cliente_nome",
                "cliente_email", "created_at", "paid_at"),
    }
