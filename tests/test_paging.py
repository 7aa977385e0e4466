"""Pages against slices of the whole sorted list, where one day and one minute hold most rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizlens.plans import paging
from quizlens.sources import files, sample
from tests.test_panels import plan_of

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    moments = [START + dt.timedelta(hours=7 * i) for i in range(60)]
    moments += [dt.datetime(2024, 1, 5, 10, 30, i % 50) for i in range(400)]       # ties in one minute
    moments += [dt.datetime(2024, 1, 5, i % 24, i % 60) for i in range(300)]
    return spark.createDataFrame(list(enumerate(moments)), "id int, ts timestamp_ntz").withColumn("dt", F.to_date("ts"))


@pytest.mark.parametrize("offset", [0, 5, 40, 45, 300, 430, 700, 755, 760, 10_000])
def test_pages_are_slices(rows, offset):
    whole = sorted(((r["ts"], r["id"]) for r in rows.collect()), reverse=True)
    got = paging.page(rows, "ts", [F.desc("id")], 25, offset)
    assert [(r["ts"], r["id"]) for r in got.rows.collect()] == whole[offset:offset + 25]
    assert got.total == 760 and got.has_more == (offset + 25 < 760)


def test_no_pages_of_nothing(rows):
    got = paging.page(rows.limit(0), "ts", ["id"], 25, 0)
    assert got.rows.count() == 0 and got.total == 0 and not got.has_more


def test_a_deep_page_reads_only_its_days(spark, data, tmp_path):
    files.append_events(sample.batches(spark, data), str(tmp_path / "log"))
    stored = files.read_log(spark, str(tmp_path / "log"), "events", "timestamp_ntz")
    whole = stored.orderBy(F.desc("ts"), F.desc("id")).collect()
    got = paging.event_page(stored, limit=50, offset=600, start="2024-01-01")
    shown = got.rows.collect()
    assert [r["id"] for r in shown] == [r["id"] for r in whole[600:650]]
    days = sorted({r["ts"].date() for r in shown})
    text = plan_of(got.rows)
    assert "dt#" in text and str(days[0]) in text and str(days[-1]) in text.split("PartitionFilters")[1].split("]")[0]


def test_a_request_without_a_limit_has_the_length_of_the_screen(spark, data):
    got = paging.session_page(sample.stored(spark, data).sessions(), start="2024-01-01")
    assert got.rows.count() == 60 and got.has_more
