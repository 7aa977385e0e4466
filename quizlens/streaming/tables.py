"""Keeping the clean tables, and the numbers of each day, up to date from streams."""

from pyspark.sql import functions as F

from quizlens.operators import folds, ingest
from quizlens.sources import files
from quizlens.plans import daily
from quizlens.sources.history import History
from quizlens.sources.versioned import Versioned, fresh_name
from quizlens.tables import Stored
from quizlens.streaming.run import drain, to_files


def stream_events(batches, path, checkpoint):
    """Append event rows under one folder per day. Row-local, so no state is kept."""
    rows = ingest.event_rows(batches).withColumn("dt", F.to_date("ts"))
    to_files(rows, path, checkpoint, by=["dt"])


def stream_clicks(batches, path, checkpoint):
    rows = ingest.click_rows(batches).withColumn("dt", F.to_date("ts"))
    to_files(rows, path, checkpoint, by=["dt"])


def stream_folds(messages, targets, checkpoint, raws=None):
    """Keep keyed tables from one stream of messages.

    ``targets`` is a list of (fold, messages -> messages, path). Each micro-batch
    is folded on its own and added to the path's ``History`` as a delivery of this
    stream with the batch's number; a micro-batch that is run again adds nothing. No state
    store grows with the number of keys, and the runs to read grow with the logarithm of
    the micro-batches. The query's id, which its checkpoint keeps, names the stream, so
    a stream that starts over with a fresh checkpoint replaces nothing. ``raws`` is a
    path for the payloads; a batch that is run again may write its payloads twice.
    """
    def store(batch, number):
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()     # read once for all targets
        try:
            if raws is not None:
                files.append_raws(batch, raws)
            for fold, choose, path in targets:
                history = History(spark, path, fold)
                history.append(choose(batch), stream, number)
                history.tidy()
        finally:
            batch.unpersist()

    drain(messages.writeStream.foreachBatch(store), checkpoint)


def stream_sessions(batches, path, checkpoint):
    every = lambda rows: rows
    stream_folds(
        ingest.snapshot_rows(batches), [(folds.sessions(), every, path)], checkpoint
    )


def stream_orders(notifications, orders_path, purchases_path, checkpoint, raws=None):
    """Orders and the purchases they stamp, from one pass over the notifications.

    A redelivered notification carries the same sequence number and values, and
    the folds are idempotent, so it changes nothing.
    """
    every = lambda rows: rows
    stream_folds(notifications, [
        (folds.orders(), every, orders_path),
        (folds.purchases(), folds.deciding, purchases_path),
    ], checkpoint, raws)


class Daily(Versioned):
    """The numbers of each day as a small table; a version replaces the days that changed."""

    SCHEMA = "dt date, sessoes int, terminaram int, ofertas int, checkouts int, pagos int, receita_cents long"

    def folders_of(self, manifest):
        return {f"days/v={manifest['write']}"}

    def rows(self):
        manifest = self.manifest()
        if not manifest:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.parquet(f"{self.path}/days/v={manifest['write']}")

    def replace(self, days, rows, seen):
        """Put ``rows`` in place of what was known of ``days``; ``seen`` is the latest moment of any message."""
        based_on, write = max(self.versions(), default=0), fresh_name("d")
        kept = self.rows().where(~F.col("dt").cast("string").isin(days) if days else F.lit(True))
        kept.unionByName(rows).coalesce(1).write.parquet(f"{self.path}/days/v={write}")     # one row a day
        latest = max(filter(None, (seen, self.manifest().get("seen"))), default=None)
        self.commit(based_on, {"write": write, "seen": latest})

    def read(self, delay):
        """Days with their numbers; a day is ``provisorio`` until messages came ``delay`` after its end."""
        seen = F.lit(self.manifest().get("seen")).cast("timestamp_ntz")
        open_day = F.to_date(seen - F.expr(f"INTERVAL {delay}"))
        return self.rows().select(
            F.date_format("dt", "yyyy-MM-dd").alias("dia"), *self.rows().columns[1:],
            (F.col("dt") >= open_day).alias("provisorio"),
        )


def both_kinds(batches, notifications):
    """One stream of batches and notifications: each row has one of the two as a struct."""
    b, n = (F.struct(*(df[c] for c in df.columns)) for df in (batches, notifications))
    return batches.select(b.alias("batch")).unionByName(notifications.select(n.alias("note")), allowMissingColumns=True)


def stream_daily_kpis(batches, notifications, path, checkpoint):
    """Keep visits, orders and the numbers of each day from two streams.

    A micro-batch is added to the stored visits and orders, where each visit and each order has one row on
    its first day, and the days it touched are counted anew from that. So a visit that crosses midnight
    counts once, a late message corrects the days it changes, and the open day is there with what has come so far.
    """
    def store(batch, number):
        spark = batch.sparkSession
        batch = batch.persist()     # read once for both tables
        try:
            stored, table = Stored(spark, path), Daily(spark, f"{path}/daily")
            visits, notes = batch.where("batch IS NOT NULL").select("batch.*"), batch.where("note IS NOT NULL").select("note.*")
            days = sorted({day for touched in stored.add(visits, notes) for day in touched})
            moments = visits.select("received_ts").unionByName(notes.select("received_ts"))
            seen = moments.agg(F.max("received_ts").cast("string")).first()[0]
            table.replace(days, daily.numbers(stored, days), seen)
        finally:
            batch.unpersist()
        for part in (stored.session_store, stored.order_store, table):
            part.vacuum()

    drain(both_kinds(batches, notifications).writeStream.foreachBatch(store), checkpoint)
    return Daily(batches.sparkSession, f"{path}/daily")
