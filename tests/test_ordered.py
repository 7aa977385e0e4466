"""Ordered operators against plain loops, with one key holding a third of the rows."""

import datetime as dt
import random

import pytest

from quizlens.operators import interactions, quota

T0 = dt.datetime(2024, 1, 1)


def skewed_keys(n, seed=1):
    rng = random.Random(seed)
    return ["hot" if rng.random() < 1 / 3 else f"k{rng.randrange(12)}" for _ in range(n)]


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


def expected_admissions(rows, limit, minutes):
    out = []
    for key, calls in by_key(rows).items():
        admitted = []
        for _, seq, ts in sorted(calls, key=lambda r: (r[2], r[1])):
            live = [a for a in admitted if a > ts - dt.timedelta(minutes=minutes)]
            allow = len(live) < limit
            if allow:
                admitted.append(ts)
            out.append((key, ts, allow, len(live) + 1 if allow else limit))
    return sorted(out)


def calls_frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, ts timestamp_ntz").repartition(5)


def test_admission_by_hand(spark):
    rows = [("a", i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 10, 20, 60, 61])]
    got = quota.rate_admission(calls_frame(spark, rows), limit=2, hours=1).orderBy("ts").collect()
    assert [r.allow for r in got] == [True, True, False, True, False]


@pytest.mark.parametrize("limit,hours", [(1, 0.1667), (5, 1), (300, 1), (0, 1)])
def test_admission_matches_a_loop(spark, limit, hours):
    rng = random.Random(limit)
    rows = [(k, i, T0 + dt.timedelta(seconds=rng.randrange(0, 40000, 5)))
            for i, k in enumerate(skewed_keys(2500))]
    got = quota.rate_admission(calls_frame(spark, rows), limit, hours)
    minutes = max(1, round(hours * 60))
    assert sorted(map(tuple, got.collect())) == expected_admissions(rows, limit, minutes)


@pytest.mark.parametrize("limit,hours", [(2, 2), (9, 1), (0, 4)])
def test_busy_stretches_match_a_loop(spark, monkeypatch, limit, hours):
    """A key that never pauses, with bursts, ties and thin hours, is decided window by window."""
    monkeypatch.setattr(quota, "BUSY", 60)
    rng = random.Random(limit)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 0, 1, 5, 20]) if i // 75 % 2 else rng.choice([30, 60, 200])
        rows.append(("hot" if i % 3 else f"k{i % 4}", i, T0 + dt.timedelta(seconds=at)))
    got = quota.rate_admission(calls_frame(spark, rows), limit, hours)
    minutes = max(1, round(hours * 60))
    assert sorted(map(tuple, got.collect())) == expected_admissions(rows, limit, minutes)


def test_places_that_collide(spark, monkeypatch):
    """Two places free before a pause: the first call after it takes one, the next call the other."""
    monkeypatch.setattr(quota, "BUSY", 3)
    rows = [("a", i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 9, 10, 10.1, 10.2, 19.5, 19.6, 20, 21])]
    got = quota.rate_admission(calls_frame(spark, rows), 2, 1 / 6)
    assert sorted(map(tuple, got.collect())) == expected_admissions(rows, 2, 10)


def test_trailing_calls_match_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, i, T0 + dt.timedelta(seconds=rng.randrange(0, 20000, 60)))
            for i, k in enumerate(skewed_keys(900))]
    hour, expected = dt.timedelta(hours=1), []
    for key, calls in by_key(rows).items():
        for _, _, ts in calls:
            expected.append((key, ts, sum(ts - hour < t <= ts for _, _, t in calls) - 1))
    got = quota.trailing_calls(calls_frame(spark, rows), hours=1)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def expected_rage(rows):
    out = []
    for key, clicks in by_key(rows).items():
        last, run = None, 0
        for _, seq, t, x, y, section in sorted(clicks, key=lambda r: (r[2], r[1])):
            near = last and abs(x - last[0]) < 30 and abs(y - last[1]) < 30 and t - last[2] < 1000
            run = run + 1 if near else 1
            if run == 3:
                out.append((key, t, section, f"b{seq}"))
            last = (x, y, t)
    return sorted(out)


CLICKS = "session_id string, seq long, ts_ms long, client_x int, client_y int, section string"


def clicks(n=3000, seed=5):
    rng = random.Random(seed)
    return [(k, i, rng.randrange(0, 400_000, 10), rng.choice([0, 20, 40, 60]), rng.choice([0, 15]), "s")
            for i, k in enumerate(skewed_keys(n, seed))]


def labelled(spark, rows):
    return spark.createDataFrame(rows, CLICKS).selectExpr("*", "concat('b', seq) AS label")


def test_rage_clicks_match_a_loop(spark):
    rows = clicks()
    got = interactions.rage_clicks(labelled(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == expected_rage(rows) != []


def test_rage_clicks_across_a_minute(spark):
    times = [58_000, 58_900, 59_800, 60_700, 61_600, 70_000, 119_999, 120_000, 120_001]
    rows = [("a", i, t, 5, 5, None) for i, t in enumerate(times)]
    got = interactions.rage_clicks(labelled(spark, rows))
    assert sorted(r.ts_ms for r in got.collect()) == [59_800, 120_001]


def test_section_as_of_matches_a_loop(spark):
    rng = random.Random(9)
    placed = [(k, i, t, x, y, rng.choice([None, None, "own"])) for k, i, t, x, y, _ in clicks(800, 6)]
    seen = [(k, 10_000 + i, t, rng.choice("abc")) for k, i, t, *_ in clicks(60, 7)]
    got = interactions.section_as_of(
        spark.createDataFrame(placed, CLICKS).repartition(5),
        spark.createDataFrame(seen, "session_id string, seq long, ts_ms long, section string"),
    ).select("session_id", "seq", "section")
    expected = []
    for key, seq, t, _, _, section in placed:
        before = [(ts, s, name) for k, s, ts, name in seen if k == key and (ts, s) <= (t, seq)]
        expected.append((key, seq, section or (max(before)[2] if before else None)))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_active_time_matches_a_loop(spark):
    rng = random.Random(11)
    rows = [(k, i, T0 + dt.timedelta(milliseconds=rng.randrange(0, 9_000_000)), rng.random() < 0.6)
            for i, k in enumerate(skewed_keys(900, 11))]
    expected = []
    for key, log in by_key(rows).items():
        log.sort(key=lambda r: (r[2], r[1]))
        seen = sum(((b[2] - a[2]) for a, b in zip(log, log[1:]) if a[3]), dt.timedelta())
        expected.append((key, seen // dt.timedelta(seconds=1)))
    frame = spark.createDataFrame(rows, "session_id string, seq long, ts timestamp_ntz, visible boolean")
    got = interactions.active_time(frame.repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
