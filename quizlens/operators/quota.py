"""Call quotas over a sliding window."""

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quizlens.functions import ordered
from quizlens.functions.values import micros
from quizlens.session import work_folder

BUSY = 1_000_000        # calls of one stretch that a task reads in order; longer ones are decided window by window


def window_micros(hours):
    """Quota window in whole minutes, at least one."""
    return max(1, int(hours * 60 + 0.5)) * 60_000_000


def trailing_calls(calls, hours=1.0):
    """Other calls of the same key in the window that ends at each call.

    Every call counts from its own moment until the window has passed. Turning
    it into a +1 and a later -1 makes the answer a running sum, which needs no
    row to look back over its window and is computed per minute of a key.

    Takes ``key, ts``; returns ``key, ts, n``.
    """
    width = window_micros(hours)
    at = calls.select("key", "ts", micros(F.col("ts")).alias("us"))
    changes = at.withColumn("step", F.lit(1)).unionByName(
        at.select("key", F.lit(None).cast(at.schema["ts"].dataType).alias("ts"),
                  (F.col("us") + width).alias("us"), F.lit(-1).alias("step"))
    )
    summed = ordered.running_sum(
        changes.withColumn("piece", ordered.piece_of(F.col("us"))), ["key"], ["us"], "step", "_n"
    )
    return summed.filter(F.col("step") == 1).select("key", "ts", (F.col("_n") - 1).alias("n"))


def _quiet_stretches(calls, width):
    """Add ``stretch``: calls of a key that may influence each other share one; and ``busy``, whether it is long.

    After a gap of a whole window nothing counts any more, so what follows is
    independent. Inside one window-long piece gaps are shorter than that, so
    only piece starts need looking at: one small row per (key, piece).
    """
    at = calls.withColumn("us", micros(F.col("ts"))).withColumn(
        "piece", ordered.piece_of(F.col("us"), width)
    )
    across = Window.partitionBy("key").orderBy("piece")
    ends = at.groupBy("key", "piece").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n")
    )
    apart = F.col("first") - F.lag("last").over(across) >= width
    fresh = F.coalesce(apart, F.lit(True))
    stretches = (
        ends.withColumn("_start", F.when(fresh, F.col("first")))
        .withColumn("stretch", F.last("_start", ignorenulls=True).over(across))
        .withColumn("busy", F.sum("n").over(Window.partitionBy("key", "stretch")) > BUSY)
        .select("key", "piece", "stretch", "busy")
    )
    return at.join(stretches, ["key", "piece"])


class Gate:
    """Admissions of one stretch of calls: the admitted moments still inside the window."""

    def __init__(self, limit, width, admitted=()):
        self.limit, self.width = limit, width
        self.admitted = deque(admitted)

    def verdicts(self, us):
        """(allow, count) for calls in time order.

        While the window is full every call is refused until the oldest admitted
        one has left it, so a refused run is skipped in one step.
        """
        allow = np.zeros(len(us), dtype=bool)
        count = np.full(len(us), self.limit, dtype=np.int64)
        i = 0
        while i < len(us) and self.limit > 0:
            while self.admitted and self.admitted[0] <= us[i] - self.width:
                self.admitted.popleft()
            if len(self.admitted) >= self.limit:
                i += int(np.searchsorted(us[i:], self.admitted[0] + self.width, side="left"))
                continue
            if self.admitted and self.admitted[-1] > us[i]:     # a late call; moments stay in order
                self.admitted = deque(sorted([*self.admitted, int(us[i])]))
            else:
                self.admitted.append(int(us[i]))
            allow[i], count[i] = True, len(self.admitted)
            i += 1
        return allow, count


def _decide(limit, width):
    def run(batches):
        current, gate = None, None
        for frame in batches:
            if frame.empty:
                continue
            key, stretch = frame["key"].to_numpy(), frame["stretch"].to_numpy()
            us, ts = frame["us"].to_numpy(), frame["ts"].to_numpy()
            turns = np.flatnonzero((key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            bounds = [0, *turns.tolist(), len(frame)]
            allow = np.zeros(len(frame), dtype=bool)
            count = np.zeros(len(frame), dtype=np.int64)
            for start, stop in zip(bounds[:-1], bounds[1:]):
                if (key[start], stretch[start]) != current:
                    current, gate = (key[start], stretch[start]), Gate(limit, width)
                allow[start:stop], count[start:stop] = gate.verdicts(us[start:stop])
            yield pd.DataFrame({"key": key, "ts": ts, "allow": allow, "count": count})
    return run


def rate_admission(calls, limit=300, hours=1.0):
    """Verdict per call: admitted while fewer than ``limit`` *admitted* calls of the
    key lie in the window; refused calls do not count.

    A verdict depends on the earlier verdicts of the key, so each stretch of
    calls is read in time order. Stretches are independent and spread over the
    cluster; a task streams its sorted rows and holds at most ``limit`` moments.
    A stretch of more than ``BUSY`` calls is not read by one task: see ``_busy_admission``.

    Takes ``key, seq, ts``; returns ``key, ts, allow, count``.
    """
    width = window_micros(hours)
    kind = calls.schema["ts"].dataType.simpleString()
    ready = _quiet_stretches(calls, width).select("key", "stretch", "busy", "us", "seq", "ts")
    verdicts = (
        ready.where(~F.col("busy")).drop("busy").repartition("key", "stretch")
        .sortWithinPartitions("key", "stretch", "us", "seq")
        .mapInPandas(_decide(limit, width), f"key string, ts {kind}, allow boolean, count long")
    )
    busy = ready.where("busy").drop("busy")
    return verdicts if busy.isEmpty() else verdicts.unionByName(_busy_admission(busy, limit, width))


def _small(df, most=1_000_000):
    """``df``, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= most else df


SLAB = ["key", "stretch", "slab"]


def _placed(calls, width):
    """Busy calls with their ``slab``, a window's length of their stretch, and their number in it, ``idx``.

    Returns them as a written table by slab, and the number of calls before each minute of a slab.
    """
    at = calls.withColumn("slab", F.expr(f"(us - stretch) div {width}")).withColumn(
        "minute", ordered.piece_of(F.col("us"))
    )
    minutes = at.groupBy(*SLAB, "minute").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*SLAB).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*SLAB, "minute").orderBy("us", "seq")
    numbered = at.withColumn("_r", F.row_number().over(inside)).join(minutes, [*SLAB, "minute"])
    path = work_folder(calls.sparkSession, "busy")
    numbered.select(*SLAB, "minute", "us", "ts", (F.col("base") + F.col("_r") - 1).alias("idx")).write.partitionBy(
        "slab"
    ).parquet(f"{path}/calls")
    minutes.write.partitionBy("slab").parquet(f"{path}/minutes")
    read = calls.sparkSession.read
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    schema = f"key {kinds['key']}, stretch long, minute long, us long, ts {kinds['ts']}, idx long, slab long"
    counts = f"key {kinds['key']}, stretch long, minute long, n long, base long, slab long"
    return path, read.schema(schema).parquet(f"{path}/calls"), read.schema(counts).parquet(f"{path}/minutes")


def _next_admitted(limit, kind):
    """Of one slab of a stretch: the numbers of the admitted calls, from the moments at which places become free."""
    def rows(key, taken):
        n = len(taken)
        return pd.DataFrame({
            "key": pd.Series([key[0]] * n, dtype=object), "stretch": np.full(n, key[1], np.int64), "idx": taken.astype(np.int64),
        })

    def decide(key, minutes: pd.DataFrame, freed: pd.DataFrame) -> pd.DataFrame:
        if minutes.empty:       # the stretch is over
            return rows(key, np.zeros(0, np.int64))
        minutes = minutes.sort_values("minute")
        starts, before = minutes["minute"].to_numpy(), np.append(minutes["base"].to_numpy(), minutes["n"].sum())
        # calls before a moment: those of earlier minutes, and those before it in its own
        freed = freed.sort_values("free")
        counts = before[np.searchsorted(starts, freed["minute"].to_numpy())] + freed["same_minute"].to_numpy()
        counts = np.concatenate([np.zeros(limit - len(counts), np.int64), counts])  # places that nobody holds
        place = np.arange(limit)
        taken = np.maximum.accumulate(counts - place) + place
        return rows(key, taken[taken < before[-1]])

    return decide, f"key {kind}, stretch long, idx long"


def _busy_admission(calls, limit, width):
    """The verdicts of long stretches, a window's length of all of them at a time.

    A call admitted in one slab gives its place free in the next, never in its own. So the calls that
    take the places of a slab follow from the admitted calls of the slab before: a place that becomes
    free at some moment goes to the first call from then on, or to the one after the last admitted one
    if that is taken. A round counts the calls before those at most ``limit`` moments, over many tasks, by
    minutes; only moments and counts meet for a stretch. Each call is read for its own slab's round.
    """
    spark, kind = calls.sparkSession, calls.schema["key"].dataType.simpleString()
    path, placed, minutes = _placed(calls, width)
    slabs = (placed.agg(F.max("slab")).first()[0] + 1) if limit > 0 else 0
    schema, admitted = f"key {kind}, stretch long, slab long, us long, idx long", None
    for slab in range(slabs):
        here, counts = placed.where(F.col("slab") == slab), minutes.where(F.col("slab") == slab)
        if admitted is None:
            freed = spark.createDataFrame([], f"key {kind}, stretch long, free long, minute long, same_minute long")
        else:
            free = F.col("us") + width
            moments = admitted.select("key", "stretch", free.alias("free"), ordered.piece_of(free).alias("minute"))
            near = here.join(_small(moments.distinct()), ["key", "stretch", "minute"]).where("us < free")
            inside = near.groupBy("key", "stretch", "free").agg(F.count("*").alias("_n"))
            freed = moments.join(_small(inside), ["key", "stretch", "free"], "left").select(
                "key", "stretch", "free", "minute", F.coalesce("_n", F.lit(0)).alias("same_minute")
            )
        decide, found = _next_admitted(limit, kind)
        taken = counts.groupBy("key", "stretch").cogroup(freed.groupBy("key", "stretch")).applyInPandas(decide, found)
        taken.write.parquet(f"{path}/taken/{slab}")
        taken = spark.read.parquet(f"{path}/taken/{slab}")
        here.join(_small(taken), ["key", "stretch", "idx"]).select(
            "key", "stretch", "us", "idx"
        ).write.parquet(f"{path}/admitted/slab={slab}")
        admitted = spark.read.schema(schema).parquet(f"{path}/admitted/slab={slab}")
    if not slabs:
        every = spark.createDataFrame([], schema)
    else:
        every = spark.read.schema(schema).parquet(f"{path}/admitted")
    # at most ``limit`` rows a window meet here, however many calls there were
    order = Window.partitionBy("key", "stretch").orderBy("us")
    gone = F.count("*").over(order.rangeBetween(Window.unboundedPreceding, -width))
    number = F.row_number().over(Window.partitionBy("key", "stretch").orderBy("slab", "idx"))
    standing = every.select(*SLAB, "idx", (number - gone).alias("_standing"))
    judged = placed.join(_small(standing), [*SLAB, "idx"], "left")
    return judged.select(
        "key", "ts", F.col("_standing").isNotNull().alias("allow"),
        F.coalesce("_standing", F.lit(limit)).cast("long").alias("count"),
    )
