"""The keyed tables: sessions, orders, and the purchase stamped on a session."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.operators.ingest import snapshot_rows
from quizlens.operators.merge import Fold, Joint, Rule

ORIGIN = ["device", "vw", "referrer", "landing_path", "utm_source", "utm_medium",
          "utm_campaign", "utm_content", "utm_term", "fbclid", "country"]


def _rules(kind, *names):
    return {name: Rule(kind, F.col(name)) for name in names}


def sessions() -> Fold:
    """Origin is fixed by the first batch; peaks only grow; answers are the latest known."""
    return Fold(
        "session_id", ["received_ts", "batch_seq"],
        first_ts=Rule("lowest", F.col("received_ts")),
        last_ts=Rule("highest", F.col("received_ts")),
        **_rules("first_row", *ORIGIN),
        **_rules("highest", "max_q"),
        **_rules("last_known", "score", "band"),
        **_rules("ever", "contact", "reached_result"),
        **_rules("highest", "max_scroll"),
        **_rules("last_known", "last_section"),
        **_rules("highest", "duration_sec", "cta_clicks"),
        **_rules("ever", "reached_checkout"),
    )


def orders() -> Fold:
    """Status follows the latest notification; details the latest known; the
    linked visit and the payment time the first. Of the payload only the number of
    the notification that has it is kept (``raw_seq``): see ``with_raw``."""
    return Fold(
        "order_id", ["received_ts", "seq"],
        **_rules("first_known", "session_id"),
        **_rules("last_row", "status"),
        **_rules("last_known", "evento", "valor_cents", "metodo", "produto", "cliente_nome",
                 "cliente_email", "cliente_fone", "utm_source", "utm_campaign"),
        raw_seq=Rule("last_row", F.col("seq")),
        created_at=Rule("lowest", F.col("received_ts")),
        updated_at=Rule("highest", F.col("received_ts")),
        paid_at=Rule("lowest", F.when(F.col("status") == "pago", F.col("received_ts"))),
    )


def purchases() -> Fold:
    """What a visit's notifications say about its purchase."""
    paid = F.col("status") == "pago"
    undone = F.col("status").isin("estornado", "chargeback")
    return Fold(
        "session_id", ["received_ts", "seq"],
        purchased=Rule("last_known", F.when(paid, True).when(undone, False)),
        purchase_cents=Rule("last_known", F.when(paid, F.col("valor_cents"))),
        purchase_ts=Rule("lowest", F.when(paid, F.col("received_ts"))),
    )


def stamped_sessions() -> Joint:
    """Visits with their purchase in one row, out of snapshots and of deciding notifications."""
    return Joint(sessions(), purchases())


def session_fold(batches: DataFrame) -> DataFrame:
    """One row per visit from all its snapshots."""
    return sessions().fold(snapshot_rows(batches))


def order_fold(notifications: DataFrame) -> DataFrame:
    """One row per order from all its notifications."""
    return finished_orders(orders().fold(notifications))


def finished_orders(folded: DataFrame) -> DataFrame:
    return folded.withColumn("moeda", F.lit("BRL"))


def with_raw(orders_df: DataFrame, notifications: DataFrame) -> DataFrame:
    """Orders with the payload of their latest notification (``raw``) in place of its number.

    Payloads never pass through the fold: those of the wanted notifications alone are
    fetched, by their number, which spreads evenly. A redelivered one counts once.
    """
    wanted = orders_df.select(F.col("raw_seq").alias("seq"))
    raws = notifications.select("seq", "raw").join(wanted, "seq", "left_semi").dropDuplicates(["seq"])
    return orders_df.withColumnRenamed("raw_seq", "seq").join(raws, "seq", "left").drop("seq")


def deciding(notifications: DataFrame) -> DataFrame:
    """The notifications that change a visit's purchase."""
    return notifications.filter(
        F.col("session_id").isNotNull()
        & F.col("status").isin("pago", "estornado", "chargeback")
    )


def purchase_fold(notifications: DataFrame, arrivals: DataFrame = None) -> DataFrame:
    """Purchase mirror per visit.

    With ``arrivals`` (session_id, first_ts) a notification received before its
    visit exists is ignored, as a live update would ignore it; without, history
    is replayed on the complete tables and the link is kept.
    """
    rows = deciding(notifications)
    if arrivals is not None:
        known = arrivals.select("session_id", "first_ts")
        rows = rows.join(known, "session_id").filter("received_ts >= first_ts").drop("first_ts")
    return purchases().fold(rows)


def stamp_purchases(sessions_df: DataFrame, purchases_df: DataFrame) -> DataFrame:
    """Sessions with their purchase mirror. Both sides hold one row per visit."""
    mirror = purchases_df.select("session_id", "purchased", "purchase_cents", "purchase_ts")
    return sessions_df.join(mirror, "session_id", "left").withColumn(
        "purchased", F.coalesce("purchased", F.lit(False))
    )
