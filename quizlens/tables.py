"""The tables the panel reads, built lazily from raw inputs."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from quizlens.operators import folds, ingest
from quizlens.sources.store import KeyedStore


@dataclass(frozen=True)
class Tables:
    """``batches`` are tracker batches, ``notifications`` normalised sale notifications.

    Nothing runs until a result is used. A deployment that stores its tables
    passes the stored DataFrames to the panel functions instead.
    """

    batches: DataFrame
    notifications: DataFrame

    @cached_property
    def events(self):
        return ingest.event_rows(self.batches)

    @cached_property
    def clicks(self):
        return ingest.click_rows(self.batches)

    @cached_property
    def visits(self):
        """Sessions without the purchase mirror: cheaper where no sale is asked for."""
        return folds.session_fold(self.batches)

    @cached_property
    def orders(self):
        return folds.order_fold(self.notifications)

    @cached_property
    def purchases(self):
        return folds.purchase_fold(self.notifications)

    @cached_property
    def sessions(self):
        return folds.stamp_purchases(self.visits, self.purchases)


class Stored:
    """Sessions and orders kept up to date below a folder, for panels that read only the days they show.

    ``add`` takes new batches and notifications in any order and any number of times.
    """

    def __init__(self, spark, path):
        self.session_store = KeyedStore(spark, f"{path}/sessions", folds.stamped_sessions(), "first_ts")
        self.order_store = KeyedStore(spark, f"{path}/orders", folds.orders(), "created_at")

    def add(self, batches: DataFrame, notifications: DataFrame):
        """Returns the days on which visits and those on which orders may have changed."""
        sessions, orders = self.session_store, self.order_store
        return (
            sessions.upsert(sessions.fold.lift(ingest.snapshot_rows(batches), folds.deciding(notifications))),
            orders.upsert(orders.fold.lift(notifications)),
        )

    def sessions(self, **days):
        """Visits with their purchase; ``start`` and ``end`` name the days to read, by default all."""
        return self.session_store.read(**days).withColumn("purchased", F.coalesce("purchased", F.lit(False)))

    def orders(self, **days):
        return folds.finished_orders(self.order_store.read(**days))
