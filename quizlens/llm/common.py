"""Helpers that the text operators share."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000      # of numbers or short keys; longer lists are joined by a shuffle
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(doc_id, modulus):
    """``crc32(doc_id as text) mod modulus``: the fold of a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder of ``spark.checkpoint.dir``, which every executor shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_sample(rows: DataFrame, key: str, per_group: int, group: str) -> DataFrame:
    """At most ``per_group`` rows of each value of ``group``, picked by a hash of ``key``.

    Used only to fit models. A group's rows are first thinned at random to about
    twice the bound, so that what meets in one task stays small at any size.
    """
    sizes = cut_lineage(rows.groupBy(group).agg(F.count("*").alias("_n")))
    thin = rows.join(few_enough(sizes), group).where(
        F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(2_000_000.0 * per_group) / F.col("_n") + 100
    )
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return thin.withColumn("_r", F.row_number().over(order)).where(f"_r <= {per_group}").drop("_r", "_n")


def running_total(rows: DataFrame, keys: list, order: list, weight: str) -> DataFrame:
    """``rows`` with ``_before``: the sum of ``weight`` over the earlier rows (by ``order``) of the same ``keys``.

    Rows are dealt to ranges of (``keys``, ``order``), which should tell rows apart, so that a hot key is
    spread; sums of whole parts carry over from one to the next. Keys must not be null.
    """
    spread = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = spread.groupBy("_part", *keys).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = spread.withColumn("_before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        summed.join(sums, ["_part", *keys]).withColumn("_before", F.col("_before") + F.col("_base")).drop("_part", "_base")
    )


def expand(rows: DataFrame, times: str, spread: list, most=100_000) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered by ``_k`` from 0.

    A row that is wanted very often is first cut into stretches of ``most``, dealt by ``spread`` to many tasks.
    """
    rows = rows.where(F.col(times) > 0)
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(most).cast("long"))))
    if not rows.where(F.col("_from") > 0).isEmpty():
        rows = rows.repartition(*spread, "_from")
    end = F.least(F.col("_from") + most, F.col(times)) - 1
    return rows.withColumn("_k", F.explode(F.sequence(F.col("_from"), end))).drop("_from")


def few_enough(rows: DataFrame) -> DataFrame:
    """``rows`` of short keys, marked for broadcast if their counted number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (few rows, bounded by the caller) with the texts of their ``doc_id``."""
    return documents.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")


class Numbering(dict):
    """Numbers strings in order of arrival; ``fresh`` holds those without a value yet."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number

    def shrink(self, keep):
        """Forget all but the first ``keep``, among which the frequent ones are."""
        for key in list(self)[keep:]:
            del self[key]


def sliced(batches, rows=1000):
    """The same rows in short batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back():
    """Return freed memory to the system, where the libraries can do that: Arrow's, and the C library's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """``run``, a map of Arrow batches, that gives its memory back when a task ends.

    Spark keeps idle workers. Those would hold the room of their last batches, twice what they need
    themselves, while later stages want it for the JVM.
    """
    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def by_batch(df: DataFrame, work, schema: str) -> DataFrame:
    """Map Arrow batches. ``work()`` is called once per task and gives the function for a batch.

    That function gets ``{column: list of values}`` and returns ``{column: values or pa.Array}``.
    """
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        step = work()
        for batch in sliced(batches):
            out = step({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            columns = [
                out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(tidied(run), target)


def sent(spark, thing):
    """A broadcast of ``thing`` that workers can open without a copy of this package (``opened``)."""
    from pyspark.cloudpickle import dumps

    return spark.sparkContext.broadcast(dumps(thing))


def opened(shared):
    import pickle

    return pickle.loads(shared.value)


def in_process(kind, key, make):
    """``make()``, kept in this Python worker for later tasks that ask for the same ``kind`` and ``key``.

    Spark reuses its workers, so what a task has looked up need not be looked up again. A worker
    keeps one object at a time, and its owner bounds its size. What the one before it held goes back to
    the system, where the C library can do that; otherwise a worker would hold the memory of both.
    """
    import gc
    import sys
    import types

    box = sys.modules.setdefault("_quizlens_kept", types.ModuleType("_quizlens_kept"))
    if getattr(box, "name", None) != (kind, key):
        box.kept = None     # before the new one is made
        gc.collect()
        give_back()
        box.kept, box.name = make(), (kind, key)
    return box.kept
