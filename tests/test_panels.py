import pytest
from pyspark.sql import functions as F

from quizlens.catalog import PERIOD, QUERIES
from quizlens.operators import ingest
from quizlens.plans import bundle, funnel, heatmap, visits
from quizlens.sources import sample


@pytest.fixture(scope="module")
def tables(spark, data):
    return sample.tables(spark, data)


def test_funnel_by_hand(spark):
    rows = [("a", 8), ("a", 0), ("b", 2), ("c", 0)]
    events = spark.createDataFrame(rows, "session_id string, step_index int").selectExpr(
        "*", "timestamp_ntz '2024-01-10' AS ts"
    )
    steps = funnel.funnel_steps(events, **PERIOD).collect()
    assert [s.sessoes for s in steps] == [3, 2, 2, 1, 1, 1, 1, 1, 1]
    assert [s.perdeu for s in steps] == [None, 1, 0, 1, 0, 0, 0, 0, 0]
    assert funnel.bottleneck(events, **PERIOD).collect()[0].step == 1


def test_empty_period(spark, tables):
    nothing = {"start": "2030-01-01"}
    assert [r.sessoes for r in funnel.funnel_steps(tables.events, **nothing).collect()] == [0] * 9
    assert [r.pct for r in heatmap.scroll_curve(tables.visits, **nothing).collect()] == [0.0] * 10


def test_shares_of_more_than_a_million_visits(spark):
    visits_ = spark.range(1_100_000).selectExpr(
        "cast(id AS string) AS session_id", "timestamp_ntz '2024-01-10' AS ts", "timestamp_ntz '2024-01-10' AS first_ts",
        "cast(8 - id % 2 * 4 AS int) AS step_index", "true AS reached_result", "cast(50 + id % 2 * 50 AS int) AS max_scroll",
    )
    steps = funnel.funnel_steps(visits_, **PERIOD).collect()
    assert [s.pct_do_topo for s in steps] == [100.0] * 5 + [50.0] * 4
    drops = funnel.funnel_drop(visits_, **PERIOD).collect()
    assert [(d.perdeu, d.pct_do_anterior) for d in drops][4:6] == [(0, 100.0), (550_000, 50.0)]
    assert [r.pct for r in heatmap.scroll_curve(visits_, **PERIOD).collect()] == [100.0] * 5 + [50.0] * 5


def test_conservation(spark, tables):
    steps = [r.sessoes for r in funnel.funnel_steps(tables.events, **PERIOD).collect()]
    assert steps == sorted(steps, reverse=True)
    tops = sum(r.sessoes for r in funnel.funnel_top_step(tables.events, **PERIOD).collect())
    assert tops == steps[0]
    curve = [r.sessoes for r in heatmap.scroll_curve(tables.visits, **PERIOD).collect()]
    assert curve == sorted(curve, reverse=True)


def test_journey_of_one_visit_equals_the_batch_form(spark, tables):
    sid = tables.visits.orderBy("first_ts").first().session_id
    parts = visits.journey_of(tables, sid)
    ids = spark.createDataFrame([(sid,)], "session_id string")
    rows = visits.session_journey(tables.events, tables.clicks, tables.orders, tables.visits, ids)
    assert parts["sessao"].count() == 1
    counts = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert counts.get("event", 0) == parts["eventos"].count()
    assert counts.get("click", 0) == parts["cliques"].count()
    assert counts.get("order", 0) == parts["pedidos"].count()


def test_screens(spark, tables):
    screens = bundle.screens(tables, **PERIOD)
    assert set(screens) == {"overview", "funnel", "heatmap", "quiz", "sales", "sessions", "events"}
    rows = bundle.as_documents(screens["funnel"]).collect()
    assert {r.bloco for r in rows} == set(screens["funnel"])
    assert sum(r.bloco == "passos" for r in rows) == 9 and any('"key":"visit"' in r.conteudo for r in rows)


def test_bad_batches_are_set_aside_not_lost(spark):
    bodies = ['{"sessionId":"abcdefgh","events":[{"name":"visit"}]}', "{oops", "[]", '{"sessionId":"short"}',
              '{"sessionId":"bad id here"}', '{"sessionId":"' + "a" * 60 + '","device":"fridge"}',
              '{"sessionId":"abcdefgh\\n"}']
    lines = spark.createDataFrame(list(enumerate(bodies)), "batch_seq long, body string").selectExpr(
        "batch_seq", "timestamp_ntz '2024-01-01' AS received_ts", "body"
    )
    marked = ingest.quarantine_batches(ingest.parse_batches(lines))
    accepted, refused = (marked.filter(F.col("destino") == side) for side in (ingest.ACCEPTED, ingest.REFUSED))
    # an id that is too long is refused like others: cut, it might be another visit's
    assert sorted(r.batch_seq for r in accepted.collect()) == [0]
    assert {r.batch_seq: r.body for r in refused.collect()} == {i: bodies[i] for i in range(1, 7)}
    assert {r.session_id for r in accepted.collect()} == {"abcdefgh"}


def test_loose_json_types(spark):
    body = ('{"sessionId":"abcdefgh","device":"mobile","session":{"maxQ":"7","score":null,"contact":1,'
            '"band":2.5,"maxScroll":140,"reachedResult":"","vw":"390"},'
            '"clicks":[{"x":"0.5","y":2,"band":"3","dead":true},{"x":null,"y":1},{"y":1},{"x":"a","y":1}]}')
    lines = spark.createDataFrame([(1, body)], "batch_seq long, body string").selectExpr(
        "batch_seq", "timestamp_ntz '2024-01-01' AS received_ts", "body"
    )
    batches = ingest.parse_batches(lines)
    (visit,) = ingest.snapshot_rows(batches).collect()
    assert (visit.max_q, visit.score, visit.contact, visit.band, visit.max_scroll) == (7, None, True, None, 100)
    assert (visit.reached_result, visit.vw, visit.duration_sec) == (False, 390, 0)
    (click,) = ingest.click_rows(batches).collect()
    assert (click.x_pct, click.y_pct, click.band, click.dead, click.is_cta) == (0.5, 1.0, 3, True, False)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "read_"))))
def test_no_pairwise_joins(name, spark, data):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_plans(spark, data):
    steps = plan_of(QUERIES["funnel_steps"](spark, data))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in steps and "partial_max" in steps
    assert "value" not in steps.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan_of(QUERIES["event_log"](spark, data))
    assert "WindowGroupLimit" in plan_of(QUERIES["journey_events"](spark, data))


def test_panels_read_only_the_stored_days_of_their_period(spark, data, tables):
    from quizlens.plans import overview, quiz, sales, visits

    one_week, stored = {"start": "2024-01-08", "end": "2024-01-14"}, sample.stored(spark, data)
    for plan, kind in (
        (overview.overview_summary, "sessions"), (overview.overview_by_day, "sessions"), (overview.overview_by_device, "sessions"),
        (overview.overview_by_source, "sessions"), (heatmap.scroll_curve, "sessions"), (quiz.quiz_dropoff, "sessions"),
        (quiz.score_distribution, "sessions"), (quiz.band_distribution, "sessions"), (sales.checkout_summary, "sessions"),
        (sales.sales_by_band, "sessions"), (sales.sales_by_source, "sessions"), (sales.rescue_list, "sessions"),
        (visits.session_count, "sessions"), (visits.session_list, "sessions"), (funnel.offer_abandonment, "sessions"),
        (sales.sales_by_day, "orders"), (sales.orders_summary, "orders"),
    ):
        df = plan(getattr(stored, kind)(), **one_week)
        text = plan_of(df)
        assert "PartitionFilters: [isnotnull(dt" in text and "SortMergeJoin" not in text, plan.__name__
        assert rows_of(df) == rows_of(plan(getattr(tables, kind), **one_week)), plan.__name__


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_no_payload_passes_through_the_order_fold(spark, data, tables):
    from quizlens.plans import sales

    assert "eventType" not in plan_of(sales.sales_by_day(tables.orders, start="2024-01-05"))
    assert "raw" not in sample.stored(spark, data).orders().columns


def test_lists_are_whole_unless_a_limit_is_given(tables):
    from quizlens.plans import log, sales

    period = {"start": "2024-01-01"}
    assert log.event_log(tables.events, **period).count() == tables.events.count() > 150
    assert sales.order_list(tables.orders, tables.visits, **period).count() == tables.orders.count() > 100
    assert log.event_log(tables.events, limit="20", **period).count() == 20


def test_screens_are_counted_one_by_one_over_stored_logs(spark, data, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shown, derived = sample.shown(spark, data), sample.tables(spark, data)
    for name in ("events", "clicks"):
        stored, whole = getattr(shown, name), getattr(derived, name)
        assert "Generate" not in plan(stored)
        assert stored.select(whole.columns).exceptAll(whole).isEmpty()
        assert whole.exceptAll(stored.select(whole.columns)).isEmpty()
    counted = bundle.result_contents(shown, str(tmp_path), **PERIOD)
    assert "Aggregate" not in plan(counted)     # the driver holds no plan of a set any more
    for screen, sets in bundle.screens(shown, **PERIOD).items():
        rows = spark.read.parquet(f"{tmp_path}/{screen}").select("tela", "bloco").collect()
        assert sorted(map(tuple, rows)) == sorted((screen, name) for name in sets)
