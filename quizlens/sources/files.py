"""Reading raw inputs, and keeping the clean tables as day-partitioned Parquet."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens import schemas
from quizlens.operators import ingest


ENVELOPE = "batch_seq long, received_ts timestamp, country string, body string, _corrupt_record string"
NOTIFICATION = "seq long, received_ts timestamp, payload string"


def read_batches(spark, path):
    """Tracker batches from JSON-lines files that carry their arrival.

    Each line is ``{"batch_seq":…, "received_ts":…, "country":…, "body":"<request text>"}``.
    """
    return ingest.parse_batches(spark.read.schema(ENVELOPE).json(path))


def follow_batches(spark, path, files_per_batch=100):
    """The same as a stream; the files taken at once bound the size of a micro-batch."""
    source = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch)
    return ingest.parse_batches(source.json(path))


def read_notifications(spark, path):
    """Sale notifications as raw text with their arrival; bodies are not interpreted here."""
    return spark.read.schema(NOTIFICATION).json(path)


def follow_notifications(spark, path, files_per_batch=100):
    source = spark.readStream.schema(NOTIFICATION).option("maxFilesPerTrigger", files_per_batch)
    return source.json(path)


def write_log(df, path, mode="append"):
    """Append event or click rows under one folder per day.

    Rows are gathered by day and the shuffle is rebalanced at run time: a busy
    day is split over many tasks, quiet ones share a task and leave few files.
    """
    by_day = df.withColumn("dt", F.to_date("ts"))
    by_day.hint("rebalance", F.col("dt")).write.mode(mode).partitionBy("dt").parquet(path)


def append_events(batches, path):
    write_log(ingest.event_rows(batches), path)


def append_clicks(batches, path):
    write_log(ingest.click_rows(batches), path)


def read_log(spark, path, kind, ts="timestamp"):
    """Stored ``events`` or ``clicks`` with their fixed schema and the ``dt`` folder column."""
    stamp = T.TimestampNTZType() if ts == "timestamp_ntz" else T.TimestampType()
    schema = getattr(schemas, kind)(stamp).add("dt", T.DateType())
    return spark.read.schema(schema).parquet(path)


def append_raws(notifications, path):
    """Store payloads by the day they came; ``folds.with_raw`` fetches the ones an order list shows."""
    by_day = notifications.select("seq", "raw", F.to_date("received_ts").alias("dt"))
    by_day.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)
