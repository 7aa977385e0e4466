"""The keyed store and the history of runs: late messages, broken writes, moved rows, compaction."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quizlens.operators import folds, ingest
from quizlens.operators.merge import Fold, Rule
from quizlens.sources import sample
from quizlens.sources.history import History
from quizlens.sources.store import KeyedStore
from quizlens.sources.versioned import due

SCHEMA = "key string, seq long, at timestamp_ntz, name string, peak int"


def fold():
    return Fold(
        "key", ["at", "seq"], first=Rule("lowest", F.col("at")), origin=Rule("first_row", F.col("name")),
        name=Rule("last_known", F.col("name")), peak=Rule("highest", F.col("peak")),
    )


def message(key, seq, day, name=None, peak=0):
    return key, seq, dt.datetime(2024, 1, day, 12, seq % 60), name, peak


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), fold(), "first", parts=3)


def put(store, rows):
    return store.upsert(store.fold.lift(store.spark.createDataFrame(rows, SCHEMA)))


def holds(store, rows):
    """The store equals the fold of all messages, each key once and in the folder of its day."""
    expected = rows_of(store.fold.fold(store.spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(store.read().drop("dt")) == expected
    assert store.read().where(F.col("dt") != F.to_date("first")).isEmpty()


def test_a_late_message_moves_a_row_and_takes_no_other_along(store):
    first = [message(f"k{i}", i, 5 + i % 4, f"n{i}", i) for i in range(40)]
    put(store, first)
    holds(store, first)
    late = [message("k1", 100, 2, "late"), message("new", 101, 6, "new")]
    assert put(store, late) == ["2024-01-02", "2024-01-06"]
    holds(store, first + late)
    held = store.states(start="2024-01-06", end="2024-01-06")
    assert held.where("key = 'k1'").isEmpty() and held.count() == 10


def test_deliveries_in_any_order_and_again(store):
    rng = random.Random(3)
    rows = [message(f"k{rng.randrange(30)}", i, rng.randrange(1, 29), rng.choice([None, "a", "b"]), i % 7) for i in range(300)]
    cuts = [rows[:100], rows[50:180], rows[100:300], rows[:60]]
    for part in cuts:
        rng.shuffle(part)
        put(store, part)
    holds(store, rows)


def test_a_broken_write_changes_nothing(store, monkeypatch):
    first = [message(f"k{i}", i, 5, "a", i) for i in range(10)]
    put(store, first)

    def fail(*_):
        raise OSError("the writer is lost")

    monkeypatch.setattr(KeyedStore, "commit", fail)
    with pytest.raises(OSError):
        put(store, [message("k1", 50, 1, "x"), message("z", 51, 5)])
    monkeypatch.undo()
    holds(store, first)
    more = [message("k2", 60, 3, "y")]
    put(store, more)
    holds(store, first + more)
    folders = len(store.folder.names("rows/v=*"))
    store.vacuum(keep=1)
    assert len(store.folder.names("rows/v=*")) < folders and store.versions() == [2]
    holds(store, first + more)


def test_a_half_written_manifest_is_not_read(store):
    rows = [message("a", 1, 5)]
    put(store, rows)
    with open(f"{store.path}/versions/{2:010d}", "w") as broken:
        broken.write('{"cells": {}')
    holds(store, rows)
    put(store, [message("b", 2, 6)])
    assert store.versions() == [1, 3]
    holds(store, rows + [message("b", 2, 6)])


def test_of_two_writers_one_fails(store, monkeypatch):
    put(store, [message("a", 1, 5)])
    original = KeyedStore._compacted

    def beaten(self, entries):
        monkeypatch.setattr(KeyedStore, "_compacted", original)
        put(KeyedStore(self.spark, self.path, fold(), "first", parts=3), [message("b", 2, 5)])
        return original(self, entries)

    monkeypatch.setattr(KeyedStore, "_compacted", beaten)
    with pytest.raises(FileExistsError):
        put(store, [message("c", 3, 5)])
    holds(store, [message("a", 1, 5), message("b", 2, 5)])


def test_key_lists_are_compacted_and_retired_keys_start_anew(store):
    rows = [message(f"k{i}", i, 1 + i, "n", i) for i in range(18)]
    for row in rows:
        put(store, [row])
    levels = [entry["level"] for entry in store.manifest()["keys"]]
    assert levels == [1, 1, 0, 0]
    holds(store, rows)
    store.drop_days("2024-01-10")
    holds(store, rows[9:])
    again = [message("k0", 200, 20, "again")]
    put(store, again)
    put(store, [message("k0", 201, 21, "later")])
    holds(store, rows[9:] + again + [message("k0", 201, 21, "later")])


def test_rows_without_a_day_wait(spark, store):
    nameless = spark.createDataFrame([("w", 1, None, "early", 3)], SCHEMA)
    store.upsert(store.fold.lift(nameless))
    assert store.read().isEmpty() and store.states().count() == 1
    put(store, [message("w", 2, 7, "seen")])
    assert [(r["key"], r["peak"], str(r["dt"])) for r in store.read().collect()] == [("w", 3, "2024-01-07")]
    assert store.states().count() == 1


def test_sessions_take_their_purchase_before_or_after_the_visit(spark, data):
    stored, tables = sample.stored(spark, data), sample.tables(spark, data)
    names = tables.sessions.columns
    assert rows_of(stored.sessions().select(names)) == rows_of(tables.sessions)
    assert rows_of(stored.orders().select(tables.orders.columns)) == rows_of(tables.orders)
    assert sample.stored(spark, data) is stored


def test_an_empty_delivery_makes_an_empty_table(store):
    assert put(store, []) == [] and store.read().isEmpty()
    put(store, [message("a", 1, 5)])
    assert put(store, []) == []
    holds(store, [message("a", 1, 5)])


def test_a_first_delivery_is_written_once(store, monkeypatch):
    monkeypatch.setattr(KeyedStore, "commit", lambda *_: None)
    put(store, [message(f"k{i}", i, 5 + i % 3) for i in range(9)])
    assert len(store.folder.names("rows/v=*")) == 1 and not store.folder.names("fresh/v=*")


def test_a_delivery_of_many_keys_shuffles_its_cells_once(store, monkeypatch):
    monkeypatch.setattr("quizlens.sources.store.FEW_KEYS", 5)
    whole, written = [], KeyedStore._write_rows
    monkeypatch.setattr(KeyedStore, "_write_rows", lambda self, rows, write: whole.append(rows) or written(self, rows, write))
    first = [message(f"k{i}", i, 5 + i % 4, f"n{i}", i) for i in range(40)]
    put(store, first)
    many = [message(f"k{i}", 100 + i, 3 + i % 5, "late", 50 + i) for i in range(30, 50)]
    put(store, many)
    holds(store, first + many)
    plan = whole[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Join" not in plan
    few = [message("k1", 200, 2, "x"), message("k45", 201, 1, "y")]
    put(store, few)
    holds(store, first + many + few)
    assert "Join" in whole[-1]._jdf.queryExecution().optimizedPlan().toString()


# history of runs

def test_runs_grow_with_the_logarithm():
    levels, most = [], 0
    for _ in range(1000):
        levels.append(0)
        while (group := due(levels)) is not None:
            levels[group[0]:group[1]] = [levels[group[0]] + 1]
        most = max(most, len(levels))
    assert most <= 7 * 4 and sum(8 ** level for level in levels) == 1000


def test_deliveries_are_merged_by_level_and_retries_are_harmless(spark, data, tmp_path):
    messages = ingest.snapshot_rows(sample.batches(spark, data))
    history = History(spark, str(tmp_path / "runs"), folds.sessions())
    for number in range(10):
        part = messages.where(F.pmod("batch_seq", F.lit(10)) == number)
        history.append(part, "stream", number)
        history.append(part, "stream", number)
        if number == 6:
            before, seen = history.manifest(), rows_of(history.read())
    assert [run["level"] for run in history.manifest()["runs"]] == [1, 0, 0]
    assert rows_of(history.read()) == rows_of(folds.sessions().fold(messages))
    # who read the manifest before the runs were merged still sees that table whole
    held = folds.sessions()
    assert rows_of(held.finish(held.merge(history._read(before["runs"])))) == seen
    history.tidy()
    assert len(history.folder.names("runs/v=*")) < 11 and len(history.versions()) == 4
    assert rows_of(history.read()) == rows_of(folds.sessions().fold(messages))
