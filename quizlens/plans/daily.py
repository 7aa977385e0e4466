"""The numbers of a day over all screens: visits by first day, orders by the day they were created."""

from functools import reduce

from pyspark.sql import functions as F

from quizlens.functions import values as v


def numbers(stored, days):
    """``dt`` and the day's visits, outcomes, paid orders and revenue, for some days (ISO texts) of stored tables.

    Only the folders of the days are read. A day on which only orders came has no visits, and the reverse.
    """
    low, high = min(days, default="0001-01-01"), max(days, default="0001-01-01")
    some = F.col("dt").cast("string").isin(days) if days else F.lit(False)
    visits = stored.sessions(start=low, end=high).where(some).groupBy("dt").agg(
        v.rows().alias("sessoes"),
        v.count_where(F.col("max_q") >= 10).alias("terminaram"),
        v.count_where(F.col("reached_result")).alias("ofertas"),
        v.count_where(F.col("reached_checkout")).alias("checkouts"),
    )
    paid = F.col("status") == "pago"
    orders = stored.orders(start=low, end=high).where(some).groupBy("dt").agg(
        v.count_where(paid).alias("pagos"), v.sum_where(F.col("valor_cents"), paid).alias("receita_cents"),
    )
    both = visits.join(orders, "dt", "full")
    counts = [c for c in both.columns if c != "dt"]
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(c, F.lit(0))), counts, both)
