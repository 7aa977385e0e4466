"""Operators that carry state between micro-batches."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quizlens.functions.values import micros
from quizlens.operators.interactions import RAGE_MS, RAGE_PX, first_section_names
from quizlens.operators.quota import Gate, window_micros

DELAY = "10 minutes"


def _expire(state, moment_ms):
    """Drop the state once event time has passed ``moment_ms``."""
    state.setTimeoutTimestamp(max(int(moment_ms), state.getCurrentWatermarkMs() + 1))


def stream_rate_admission(calls, limit=300, hours=1.0, delay=DELAY):
    """Verdicts on calls as they arrive; the state of a key is its admitted calls
    still inside the window, at most ``limit`` moments.

    A gate answers at once, so calls are judged as they arrive: in time order inside a
    micro-batch, and a call that comes late is judged by what the gate has admitted
    since. The batch operator judges all calls in time order; both agree on calls that
    arrive in order. Takes a stream of ``key, seq, ts``. How many calls of one key meet in a task
    is bounded by the size of a micro-batch.
    """
    width = window_micros(hours)

    def decide(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "seq"])
        gate = Gate(limit, width, state.get[0] if state.exists else ())
        allow, count = gate.verdicts(rows["us"].to_numpy())
        state.update((list(gate.admitted),))
        _expire(state, (int(rows["us"].max()) + width) // 1000)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "allow": allow, "count": count})

    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.withColumn("us", micros(F.col("ts"))).groupBy("key").applyInPandasWithState(
        decide, "key string, ts timestamp, allow boolean, count long", "admitted array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


HELD = ["ts_ms", "seq", "client_x", "client_y", "section", "label"]
PIECE_MS, REACH_MS = 60_000, 3 * RAGE_MS


def _goes_on(click, previous):
    """Whether a click continues the run of the one before it; without one it does not."""
    far = lambda c: F.abs(click[c].cast("long") - previous[c]) >= RAGE_PX
    late = click["ts_ms"] - previous["ts_ms"] >= RAGE_MS
    return F.coalesce(~(far("client_x") | far("client_y") | late), F.lit(False))


def stream_rage_clicks(clicks, delay=DELAY):
    """Rage clicks, each given out once the watermark has passed its minute.

    Clicks may arrive in any order within ``delay``; later ones, whose minute is closed, are dropped.
    Takes a stream of ``session_id, seq, ts_ms, client_x, client_y, section, label``; a click without a
    time is in no minute. The state is one list of clicks per visit and minute, with the 3 s before that
    minute, which is as far back as a third click looks; the watermark closes it. A list is sorted in
    memory. The lists are best kept in RocksDB (``run.keeping_lists``).
    """
    timed = clicks.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    lengths = [f"{ms} milliseconds" for ms in (PIECE_MS + REACH_MS, PIECE_MS, PIECE_MS - REACH_MS)]
    pieces = timed.groupBy("session_id", F.window("at", *lengths)).agg(
        F.sort_array(F.collect_list(F.struct(*HELD))).alias("clicks")
    )
    runs = pieces.withColumn("on", F.transform("clicks", lambda c, i: _goes_on(c, F.get("clicks", i - 1))))
    before = lambda i, n: F.coalesce(F.get("on", i - n), F.lit(False))
    own = F.unix_millis("window.start") + REACH_MS
    third = lambda c, i: before(i, 0) & before(i, 1) & ~before(i, 2) & (c["ts_ms"] >= own)
    found = runs.select("session_id", F.inline(F.filter("clicks", third)))
    return found.select("session_id", "ts_ms", "section", "label")


def stream_dedup_sections(views, delay="1 day"):
    """Section views once per visit and block.

    ``delay`` must be at least as long as a visit can last: an older view is
    forgotten and could be given out again.
    """
    timed = views.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    firsts = timed.dropDuplicatesWithinWatermark(["session_id", "section"])
    return first_section_names(firsts)
