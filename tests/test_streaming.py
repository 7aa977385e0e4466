"""Streams over several micro-batches end where the batch operators do."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlens.catalog import QUERIES
from quizlens.operators import folds, interactions, quota
from quizlens.plans import overview, sales
from quizlens.schemas import SNAPSHOT_IN
from quizlens.sources import files, sample
from quizlens.sources.history import History
from quizlens.streaming import live
from quizlens.streaming import tables as streams
from quizlens.streaming.run import collected, keeping_lists


@pytest.fixture(scope="module")
def split(spark, data, tmp_path_factory):
    """The tables cut into four files each, in time order."""
    folder = tmp_path_factory.mktemp("split")
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        rows = spark.read.parquet(f"{data}/{name}.parquet").orderBy(key).toPandas()
        size = -(-len(rows) // 4)
        schema = spark.read.parquet(f"{data}/{name}.parquet").schema
        for i in range(4):
            part = spark.createDataFrame(rows.iloc[i * size:(i + 1) * size], schema).coalesce(1)
            part.write.parquet(str(folder / f"{name}-tmp{i}"))
            (source,) = (folder / f"{name}-tmp{i}").glob("*.parquet")
            (folder / f"{name}-{i}.parquet").write_bytes(source.read_bytes())
    return sample.Live(str(folder), like=data)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_events(spark, data, split, tmp_path):
    batches = sample.batches(spark, split)
    streams.stream_events(batches, str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    stored = files.read_log(spark, str(tmp_path / "rows"), "events", "timestamp_ntz").drop("dt")
    same(stored, sample.tables(spark, data).events)


def test_sessions(spark, data, split, tmp_path):
    batches = sample.batches(spark, split)
    streams.stream_sessions(batches, str(tmp_path / "states"), str(tmp_path / "checkpoint"))
    history = History(spark, str(tmp_path / "states"), folds.sessions())
    assert len(history.manifest()["runs"]) > 1
    same(history.read(), sample.tables(spark, data).visits)


def test_orders_and_purchases(spark, data, split, tmp_path):
    notes = sample.normalized(sample.flat_notifications(spark, split))
    o, p, raws = (str(tmp_path / name) for name in ("o", "p", "raws"))
    streams.stream_orders(notes, o, p, str(tmp_path / "checkpoint"), raws)
    tables = sample.tables(spark, data)
    orders = folds.finished_orders(History(spark, o, folds.orders()).read())
    same(orders, tables.orders)
    same(folds.with_raw(orders, spark.read.parquet(raws)), folds.with_raw(tables.orders, tables.notifications))
    same(History(spark, p, folds.purchases()).read(), tables.purchases)


def test_a_fresh_stream_replaces_no_compacted_history(spark, data, tmp_path):
    path, visits = str(tmp_path / "sessions"), sample.tables(spark, data).visits
    for name in ("first", "second"):
        streams.stream_sessions(sample.batches(spark, sample.Live(data)), path, str(tmp_path / name))
    history = History(spark, path, folds.sessions())
    assert len(history.manifest()["last"]) == 2
    same(history.read(), visits)


def test_rate_admission(spark, data, split):
    live_rows = collected(
        spark, live.stream_rate_admission(sample.calls(spark, split), limit=3, hours=24), "quota"
    ).selectExpr("key", "cast(ts AS timestamp_ntz) AS ts", "allow", "count")
    same(live_rows, quota.rate_admission(sample.calls(spark, data), limit=3, hours=24))


def test_rage_clicks_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(5)
    rows, clock = [], 1_000_000_000
    for seq in range(400):      # one visit holds a third of the clicks
        clock += rng.choice([20, 60, 150, 600])
        visit = "hot" if seq % 3 == 0 else f"v{seq % 7}"
        rows.append((visit, seq, clock, rng.choice([10, 20, 60]), 5, rng.choice(["a", None]), f"b{seq}"))
    schema = "session_id string, seq long, ts_ms long, client_x int, client_y int, section string, label string"
    rows.append(("last", 400, clock + 3_600_000, 0, 0, None, None))     # moves the watermark past all
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):          # every file has clicks of the whole time, so three of four come late
        part = rows[i:400:4] + (rows[400:] if i == 3 else [])
        rng.shuffle(part)
        one = spark.createDataFrame(part, schema).coalesce(1)
        one.write.parquet(str(tmp_path / f"part{i}"))
        (source,) = (tmp_path / f"part{i}").glob("*.parquet")
        (folder / f"{i}.parquet").write_bytes(source.read_bytes())
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    with keeping_lists(spark):
        got = collected(spark, live.stream_rage_clicks(stream), "rage")
    expected = interactions.rage_clicks(spark.createDataFrame(rows, schema))
    assert expected.count() > 5
    same(got, expected)


CLICKS = "session_id string, seq long, ts_ms long, client_x int, client_y int, section string, label string"


def test_rage_clicks_of_odd_rows(spark, tmp_path):
    """Clicks without a place, a time, a number or a visit, clicks that come twice, runs across a minute."""
    rng, rows = random.Random(6), []
    for visit in ("a", "b", None):
        clock = 1_000_000_000 - rng.randrange(60_000)
        for seq in range(300):
            clock += rng.choice([0, 300, 600, 999, 1000, 15_000])
            row = [visit, seq, clock, rng.choice([10, 20, 20, 60]), 5, rng.choice(["a", None]), f"b{seq}"]
            odd = rng.randrange(60)
            if odd in (1, 2, 3, 4, 5, 6):
                row[odd] = None
            rows += [tuple(row)] * (2 if odd == 7 else 1)
    minute = 1_000_020_000      # a minute's start: the third clicks are its last and its first ones
    for visit, first in (("c", minute - 601), ("d", minute - 600), ("e", minute - 1)):
        rows += [(visit, i, first + 300 * i, 10, 5, "a", f"{visit}{i}") for i in range(5)]
    rows.append(("last", 0, 2_000_000_000, 0, 0, None, None))       # moves the watermark past all
    spark.createDataFrame(rows, CLICKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CLICKS).parquet(str(tmp_path / "in"))
    with keeping_lists(spark):
        got = collected(spark, live.stream_rage_clicks(stream), "rage")
    expected = interactions.rage_clicks(spark.createDataFrame(rows, CLICKS))
    assert {r["session_id"] for r in expected.collect()} == {"a", "b", "c", "d", "e", None}
    same(got, expected)


def test_rage_clicks_call_no_python_per_visit(spark, tmp_path):
    """Visits are many: with calls of Python for each of them, 6 million clicks took more than 400 s."""
    stream = spark.readStream.schema(CLICKS).parquet(str(tmp_path))
    plan = live.stream_rage_clicks(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan and "PySpark" not in plan


def test_rage_clicks_leave_no_closed_minute_in_the_state(spark, tmp_path):
    """One visit of an hour: what is kept is its open minutes, not its history."""
    for i in range(3):          # twenty minutes of clicks a file
        rows = [("hot", n, n * 400 + 600_000, 10, 5, "a", f"b{n}") for n in range(3000 * i, 3000 * i + 3000)]
        spark.createDataFrame(rows, CLICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with keeping_lists(spark):
        found = live.stream_rage_clicks(stream, delay="1 minute")
        writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    assert [r["label"] for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()] == ["b2"]


def test_a_late_call_keeps_the_gate_in_order():
    gate = quota.Gate(3, 100)
    assert gate.verdicts(np.array([0, 50]))[0].all() and gate.verdicts(np.array([20]))[0].all()
    assert list(gate.admitted) == [0, 20, 50] and not gate.verdicts(np.array([60]))[0].any()
    assert gate.verdicts(np.array([100]))[0].all() and list(gate.admitted) == [20, 50, 100]


def test_rage_clicks_of_shuffled_files(spark, data, tmp_path):
    """The registered query over four files of mixed times finds every click of the batch operator."""
    rows = spark.read.parquet(f"{data}/events.parquet")
    for i in range(4):
        part = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1)
        part.write.parquet(str(tmp_path / f"tmp{i}"))
        (source,) = (tmp_path / f"tmp{i}").glob("*.parquet")
        (tmp_path / f"events-{i}.parquet").write_bytes(source.read_bytes())
    rows.write.parquet(str(tmp_path / "like" / "events.parquet"))

    class Folder(str):
        """Reads as streams the four files, and as a table the whole."""

    original = sample.table

    def table(session, folder, name):
        if isinstance(folder, sample.Live):
            return original(session, sample.Live(str(tmp_path), like=data), name)
        return original(session, data, name)

    sample.table = table
    try:
        got = QUERIES["stream_rage_clicks"](spark, Folder(data))
    finally:
        sample.table = original
    expected = QUERIES["rage_clicks"](spark, data)
    assert expected.count() > 20
    same(got, expected)


def test_daily_numbers_follow_late_messages(spark, data, split, tmp_path):
    notes = sample.normalized(sample.flat_notifications(spark, split))
    days = streams.stream_daily_kpis(sample.batches(spark, split), notes, str(tmp_path / "t"), str(tmp_path / "c"))
    tables, got = sample.tables(spark, data), days.read("10 minutes")
    visits = {r["dia"]: tuple(r) for r in overview.overview_by_day(tables.visits, start="2024-01-01").collect()}
    paid = {r["dia"]: tuple(r) for r in sales.sales_by_day(tables.orders, start="2024-01-01").collect()}
    assert {r["dia"] for r in got.collect()} == set(visits) | set(paid)
    for r in got.collect():
        assert tuple(r)[:5] == visits.get(r["dia"], (r["dia"], 0, 0, 0, 0))
        assert (r["pagos"], r["receita_cents"]) == paid.get(r["dia"], (r["dia"], 0, 0))[1:]
    assert [r["dia"] for r in got.where("provisorio").collect()] == [max(r["dia"] for r in got.collect())]


def test_a_visit_across_midnight_counts_once(spark, tmp_path):
    schema = "batch_seq long, received_ts timestamp_ntz, sessionId string, device string, country string, " \
             f"events array<struct<name:string>>, session {SNAPSHOT_IN.simpleString()}"
    moments = [(2, "2024-01-02 00:10:00", 4), (1, "2024-01-01 23:55:00", 3), (3, "2024-01-02 00:20:00", 10)]
    snapshot = {f.name: None for f in SNAPSHOT_IN.fields}
    note = "seq long, received_ts timestamp_ntz, order_id string, session_id string, status string, evento string, " \
           "valor_cents int, metodo string, produto string, cliente_nome string, cliente_email string, cliente_fone string, " \
           "utm_source string, utm_campaign string, raw string"
    spark.createDataFrame([], note).write.parquet(str(tmp_path / "notes"))
    got = []
    for seq, ts, peak in moments:
        row = (seq, dt.datetime.fromisoformat(ts), "visit-0001", "mobile", None, [], {**snapshot, "maxQ": peak})
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        batches = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        notes = spark.readStream.schema(note).parquet(str(tmp_path / "notes"))
        days = streams.stream_daily_kpis(batches, notes, str(tmp_path / "t"), str(tmp_path / "c"))
        got.append([tuple(r)[:3] for r in days.read("10 minutes").collect()])
    assert got == [[("2024-01-02", 1, 0)], [("2024-01-01", 1, 0)], [("2024-01-01", 1, 1)]]


def test_once_only_sections(spark, data, split):
    stream = live.stream_dedup_sections(sample.section_views(spark, split), delay="60 days")
    batch = QUERIES["first_section_views"](spark, data)
    keys = ["session_id", "event_name", "section"]
    same(collected(spark, stream, "sections").select(keys), batch.select(keys))
