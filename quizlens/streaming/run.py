"""Running a stream over what has arrived so far."""

from contextlib import contextmanager

from quizlens.session import work_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keeping_lists(spark):
    """Streams started inside keep their state in RocksDB, which leaves long lists out of the heap."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drain(writer, checkpoint):
    """Start a stream on the data available now and wait until it is consumed."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def to_files(stream, path, checkpoint, mode="append", by=()):
    """Append a stream's rows to Parquet; the file sink commits each batch once."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    if by:
        writer = writer.partitionBy(*by)
    drain(writer, checkpoint)


def collected(spark, stream, name):
    """A drained stream's output as a DataFrame read back from the shared folder."""
    folder = work_folder(spark, name)
    to_files(stream, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
