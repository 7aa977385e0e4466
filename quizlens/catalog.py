"""Every query by name: ``(spark, folder) -> DataFrame`` over the tables of a folder."""

from pyspark.sql import functions as F

from quizlens.fixed_values import JOURNEY_LIMITS, LIST_LIMITS, MAX_CLICKS_PER_BATCH, MAX_EVENTS_PER_BATCH, TOP
from quizlens.functions import browser, sales
from quizlens.functions import values as v
from quizlens.functions.period import period_filter
from quizlens.operators import folds, ingest, interactions, payload, quota, retention
from quizlens.plans import bundle, funnel, heatmap, log, overview, paging, quiz, visits
from quizlens.plans import sales as sales_plans
from quizlens.session import work_folder
from quizlens.sources import files, sample
from quizlens.sources.history import History
from quizlens.sources.store import KeyedStore
from quizlens.streaming import live
from quizlens.streaming import tables as streams
from quizlens.streaming.run import collected, keeping_lists, to_files

PERIOD = {"start": "2024-01-05", "end": "2024-01-25"}
AS_OF = "2024-02-15 00:00:00"

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def panel(query_name, plan, *sources, **args):
    """Register a panel plan for the fixed period, over stored sessions and orders and derived logs."""
    def run(spark, folder):
        return plan(*[_source(spark, folder, source) for source in sources], **args, **PERIOD)

    QUERIES[query_name] = run


def _source(spark, folder, name):
    if name in ("visits", "sessions"):
        return sample.stored(spark, folder).sessions()
    if name == "orders":
        return sample.stored(spark, folder).orders()
    return getattr(sample.tables(spark, folder), name)


panel("overview_summary", overview.overview_summary, "sessions")
panel("overview_by_day", overview.overview_by_day, "visits")
panel("overview_by_device", overview.overview_by_device, "visits")
panel("overview_by_source", overview.overview_by_source, "visits", most=TOP["overview_by_source"])

panel("funnel_top_step", funnel.funnel_top_step, "events")
panel("funnel_steps", funnel.funnel_steps, "events")
panel("funnel_zero_fill", funnel.funnel_zero_fill, "events")
panel("funnel_cumulative", funnel.funnel_cumulative, "events")
panel("funnel_drop", funnel.funnel_drop, "events")
panel("bottleneck", funnel.bottleneck, "events")
panel("section_reach", funnel.section_reach, "events")
panel("offer_abandonment", funnel.offer_abandonment, "visits", most=TOP["offer_abandonment"])
panel("cta_ranking", funnel.cta_ranking, "events", most=TOP["cta_ranking"])
panel("capture_outcome", funnel.capture_outcome, "events")

panel("heat_grid", heatmap.heat_grid, "clicks")
panel("heat_grid_cut", heatmap.heat_grid, "clicks", cols=20, rows=50,
      cuts={"device": "mobile", "band": 2, "section": "preco"})
panel("element_ranking", heatmap.element_ranking, "clicks", most=TOP["element_ranking"])
panel("dead_clicks", heatmap.dead_clicks, "clicks", most=TOP["dead_clicks"])
panel("clicks_by_section", heatmap.clicks_by_section, "clicks")
panel("scroll_curve", heatmap.scroll_curve, "visits")
panel("scroll_curve_cut", heatmap.scroll_curve, "visits", device="mobile", band=3)

panel("question_accuracy", quiz.question_accuracy, "events")
panel("quiz_dropoff", quiz.quiz_dropoff, "visits")
panel("score_distribution", quiz.score_distribution, "visits")
panel("band_distribution", quiz.band_distribution, "visits")

panel("orders_summary", sales_plans.orders_summary, "orders")
panel("checkout_summary", sales_plans.checkout_summary, "sessions")
panel("sales_by_day", sales_plans.sales_by_day, "orders")
panel("sales_by_band", sales_plans.sales_by_band, "sessions")
panel("sales_by_source", sales_plans.sales_by_source, "sessions", most=TOP["sales_by_source"])
panel("order_list", sales_plans.order_list, "orders", "visits", limit=LIST_LIMITS["orders"][-1])
panel("order_list_problem", sales_plans.order_list, "orders", "visits", filtro="problema", limit=50)
panel("rescue_list", sales_plans.rescue_list, "sessions", most=TOP["rescue_list"])

panel("session_list", visits.session_list, "sessions", filtro="cta", device="mobile",
      limit=100, offset=20)
panel("session_list_after", visits.session_list, "sessions", limit=150,
      after=("2024-01-20 12:00:00", ""))
panel("session_count", visits.session_count, "sessions", filtro="nao-comprou")

panel("events_by_type", log.events_by_type, "events")
panel("event_count", log.event_count, "events", name="quiz_answer")
panel("event_log", log.event_log, "events", name="cta_click", limit=200, offset=100)
panel("event_log_after", log.event_log, "events", after=("2024-01-20 12:00:00", 0),
      limit=LIST_LIMITS["events"][-1])


@query
def heat_totals(spark, folder):
    return heatmap.heat_totals(heatmap.heat_grid(sample.tables(spark, folder).clicks, **PERIOD))


@query
def heat_intensity(spark, folder):
    return heatmap.heat_intensity(heatmap.heat_grid(sample.tables(spark, folder).clicks, **PERIOD))


@query
def append_events(spark, folder):
    return sample.tables(spark, folder).events


def _wide_clicks(clicks):
    """Positions as doubles, to compare them digit by digit."""
    shares = [F.col(c).cast("double").alias(c) for c in ("x_pct", "y_pct", "sec_pct")]
    return clicks.select(*[c for c in clicks.columns if not c.endswith("_pct")], *shares)


@query
def append_clicks(spark, folder):
    return _wide_clicks(sample.tables(spark, folder).clicks)


@query
def batch_caps(spark, folder):
    """Batches of 64 events and clicks, of which 40 and 60 are taken."""
    batches = sample.big_batches(spark, folder)
    events = ingest.event_rows(batches, MAX_EVENTS_PER_BATCH).groupBy("session_id").agg(v.rows().alias("eventos"))
    clicks = ingest.click_rows(batches, MAX_CLICKS_PER_BATCH).groupBy("session_id").agg(v.rows().alias("cliques"))
    return clicks.join(events, "session_id", "left")


@query
def session_fold(spark, folder):
    return sample.tables(spark, folder).visits


@query
def order_fold(spark, folder):
    tables = sample.tables(spark, folder)
    return folds.with_raw(tables.orders, tables.notifications)


@query
def purchase_fold(spark, folder):
    return sample.tables(spark, folder).purchases


@query
def purchase_fold_strict(spark, folder):
    tables = sample.tables(spark, folder)
    return folds.purchase_fold(tables.notifications, arrivals=tables.visits)


@query
def stamp_purchases(spark, folder):
    return sample.tables(spark, folder).sessions


def _deliveries(rows, number):
    """The first half of the month, then its second half, then every third message of all the month, late."""
    late = sample.late(F.col(number))
    half = F.day("received_ts") >= 15
    return [rows.where(~late & ~half), rows.where(~late & half), rows.where(late)]


@query
def upsert_sessions(spark, folder):
    """Visits kept in a store over three deliveries, of which the last changes days of all the month."""
    fold = folds.sessions()
    store = KeyedStore(spark, work_folder(spark, "sessions"), fold, "first_ts")
    for rows in _deliveries(ingest.snapshot_rows(sample.batches(spark, folder)), "batch_seq"):
        store.upsert(fold.lift(rows))
    return store.read().drop("dt")


@query
def upsert_orders(spark, folder):
    fold, notifications = folds.orders(), sample.tables(spark, folder).notifications
    path = work_folder(spark, "orders")
    store = KeyedStore(spark, f"{path}/orders", fold, "created_at")
    for rows in _deliveries(notifications, "seq"):
        store.upsert(fold.lift(rows))
        files.append_raws(rows, f"{path}/raws")
    return folds.with_raw(folds.finished_orders(store.read().drop("dt")), spark.read.parquet(f"{path}/raws"))


@query
def orders_with_session(spark, folder):
    tables = sample.tables(spark, folder)
    return sales_plans.orders_with_session(tables.orders, tables.visits)


@query
def order_filter(spark, folder):
    orders = sample.tables(spark, folder).orders
    return sales_plans.order_filter(orders, "problema").select("order_id", "status")


@query
def session_filter(spark, folder):
    """How many visits each behaviour filter keeps."""
    conditions = [v.count_where(c()).alias(n.replace("-", "_"))
                  for n, c in visits.SESSION_FILTERS.items()]
    return sample.tables(spark, folder).sessions.agg(*conditions)


def _journey(spark, folder, most=None):
    t = sample.tables(spark, folder)
    return visits.session_journey(t.events, t.clicks, t.orders, t.visits, most=most)


@query
def session_journey(spark, folder):
    return _journey(spark, folder)


@query
def retention_query(spark, folder):
    t = sample.tables(spark, folder)
    named = {"events": t.events, "clicks": t.clicks, "sessions": t.sessions,
             "calls": sample.calls(spark, folder), "orders": t.orders}
    return retention.retention_summary(named, as_of=AS_OF)


@query
def retained_sessions(spark, folder):
    sessions = sample.tables(spark, folder).sessions
    return retention.retained("sessions", sessions, "2024-04-15 00:00:00").select(
        "session_id", "first_ts", "purchased"
    )


@query
def evolve_schema(spark, folder):
    sessions = sample.tables(spark, folder).sessions
    older = sessions.filter("day(first_ts) < 10").drop("purchased", "purchase_cents", "purchase_ts")
    current = sessions.filter("day(first_ts) >= 10")
    return retention.evolve_sessions(older, current).select(
        "session_id", "purchased", "purchase_cents", "purchase_ts"
    )


@query
def panel_bundle(spark, folder):
    """Rows and contents of every result set of the seven screens."""
    limits = {screen: default for screen, (_, _, default) in LIST_LIMITS.items()}
    shown, path = sample.shown(spark, folder), work_folder(spark, "screens")
    return bundle.result_contents(shown, path, tops=TOP, limits=limits, **PERIOD)


@query
def session_store(spark, folder):
    """Visits per day and device from the stored sessions; only the days of the period are read."""
    stored = period_filter(sample.stored(spark, folder).sessions(**PERIOD), "first_ts", **PERIOD)
    return stored.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dia"), "device").agg(
        v.rows().alias("sessoes"), v.count_where(F.col("purchased")).alias("compras"),
        F.sum("purchase_cents").cast("long").alias("receita_cents"),
    )


@query
def order_store(spark, folder):
    """Sales by day from the stored orders; only the days of the period are read."""
    return sales_plans.sales_by_day(sample.stored(spark, folder).orders(**PERIOD), **PERIOD)


@query
def period_filter_query(spark, folder):
    """Rows kept by each form of the period argument."""
    events = sample.table(spark, folder, "events").select("ts")
    forms = {
        "both": {"start": "2024-01-05", "end": "2024-01-25"}, "from_only": {"start": "2024-01-05"},
        "to_only": {"end": "2024-01-25"}, "none": {},
    }
    parts = [
        period_filter(events, "ts", **form, as_of=AS_OF)
        .agg(F.lit(name).alias("form"), v.rows().alias("n"))
        for name, form in forms.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _labelled_clicks(spark, folder):
    return sample.clicks_px(spark, folder).withColumn("label", F.concat(F.lit("b"), "seq"))


@query
def rage_clicks(spark, folder):
    return interactions.rage_clicks(_labelled_clicks(spark, folder))


@query
def section_as_of(spark, folder):
    return interactions.section_as_of(
        sample.clicks_px(spark, folder), sample.section_views_px(spark, folder)
    )


@query
def scroll_milestones(spark, folder):
    return interactions.scroll_milestones(sample.scroll_log(spark, folder))


@query
def first_section_views(spark, folder):
    return interactions.first_section_views(sample.section_views(spark, folder))


@query
def quiz_step_events(spark, folder):
    return interactions.quiz_step_events(sample.answers(spark, folder))


@query
def click_events(spark, folder):
    return interactions.click_events(_labelled_clicks(spark, folder))


@query
def page_clicks(spark, folder):
    return interactions.page_clicks(_labelled_clicks(spark, folder))


@query
def active_time(spark, folder):
    return interactions.active_time(sample.visibility_log(spark, folder))


@query
def trailing_calls(spark, folder):
    return quota.trailing_calls(sample.calls(spark, folder), hours=24)


@query
def rate_admission(spark, folder):
    return quota.rate_admission(sample.calls(spark, folder), limit=3, hours=24)


@query
def utm_params(spark, folder):
    pages = sample.table(spark, folder, "pages")
    return pages.select("page_id", *browser.campaign_params(F.col("url")))


@query
def device_class(spark, folder):
    flat = sample.flat_batches(spark, folder)
    return flat.select("batch_seq", browser.device_class(F.col("vw")).alias("device"))


@query
def norm_click_xy(spark, folder):
    c = F.col
    return sample.pointer(spark, folder).select(
        "seq",
        browser.page_x(c("client_x"), c("window_width")).alias("x"),
        browser.page_y(c("page_y"), c("document_height"), c("window_height")).alias("y"),
        browser.block_pct(c("client_y"), c("block_top"), c("block_height")).alias("sec_pct"),
    )


@query
def scroll_pct(spark, folder):
    c = F.col
    return sample.pointer(spark, folder).select("seq", browser.scroll_pct(
        c("scroll_y"), c("document_height"), c("window_height")
    ).alias("pct"))


@query
def clean_label(spark, folder):
    n = F.col("doc_id")
    return sample.table(spark, folder, "documents").select("doc_id", browser.clean_label(
        F.when(n % 11 == 0, "cta-topo").when(n % 11 == 1, ""), F.when(n % 11 == 2, "Comprar"),
        F.when(n % 7 == 0, "IMG").otherwise("DIV"), F.when(n % 2 == 0, F.col("lang")),
        F.when(n % 5 == 0, "  ").otherwise(F.col("text")),
    ).alias("label"))


@query
def truncate_text(spark, folder):
    text = F.nullif("text", F.lit("x"))
    return sample.table(spark, folder, "documents").select(
        "doc_id", v.cut(text, 120).alias("rotulo"), v.cut_or_null(text, 40).alias("fone"),
        v.blank_to(F.col("source"), "direto").alias("origem"),
    )


@query
def normalize_key(spark, folder):
    return sample.table(spark, folder, "documents").select(
        "doc_id", sales.normalize_key(F.col("source")).alias("source"),
        sales.normalize_key(F.col("text")).alias("text"),
    )


@query
def cap_raw(spark, folder):
    docs = sample.table(spark, folder, "documents").select(
        "doc_id", sales.cap_raw(F.col("text")).alias("raw"),
    )
    return docs.select("doc_id", F.length("raw").alias("tamanho"), F.md5("raw").alias("digest"))


@query
def order_key_fallback(spark, folder):
    return sample.table(spark, folder, "documents").select(
        "doc_id", sales.fallback_order_id(F.col("text")).alias("order_id")
    )


@query
def extract_session_id(spark, folder):
    """Whole texts with a link hidden in every third one."""
    hidden = F.concat_ws(" ", "text", F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("sck=btabcdefghijk"), "doc_id", F.lit("&x=1"))
    ))
    return sample.table(spark, folder, "documents").select(
        "doc_id", sales.session_in_text(hidden).alias("session_id")
    )


@query
def normalize_amount(spark, folder):
    flat = sample.flat_notifications(spark, folder)
    cents = sales.amount_cents(F.col("valor_key"), F.col("valor_raw"))
    return flat.select("seq", cents.alias("valor_cents"), v.cents_to_unit(cents).alias("valor"))


@query
def normalize_status(spark, folder):
    flat = sample.flat_notifications(spark, folder)
    return flat.select("seq", sales.status(F.col("status_raw")).alias("status"))


@query
def normalize_method(spark, folder):
    """Methods as declared, and every order priority as an unknown method."""
    orders = sample.table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, "bank_slip").otherwise(F.col("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("seq"), sales.method(text).alias("metodo"))


@query
def payload_leaves(spark, folder):
    return payload.payload_leaves(sample.raw_notifications(spark, folder))


@query
def first_by_name(spark, folder):
    return payload.first_by_name(sample.raw_notifications(spark, folder))


def _ids(spark, folder):
    return payload.with_ids(payload.with_leaves(sample.raw_notifications(spark, folder)))


@query
def order_id_resolution(spark, folder):
    return _ids(spark, folder).select("seq", "order_id")


@query
def session_link(spark, folder):
    return _ids(spark, folder).select("seq", "session_id")


@query
def notifications_to_orders(spark, folder):
    messages = payload.extract(sample.raw_notifications(spark, folder))
    return folds.with_raw(folds.order_fold(messages), messages)


# ---------------------------------------------------------- files and streams
def _batch_files(spark, folder):
    """The batches written as JSON-lines files."""
    path = work_folder(spark, "batches")
    sample.batch_bodies(spark, folder).write.option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).json(path)
    return path


def _stored_batches(spark, folder):
    """The batches through files and back."""
    read = files.read_batches(spark, _batch_files(spark, folder))
    return read.withColumn("received_ts", F.col("received_ts").cast("timestamp_ntz"))


@query
def read_batches(spark, folder):
    """Snapshots of the batches that survive a trip through JSON files."""
    return ingest.snapshot_rows(_stored_batches(spark, folder)).select(
        "session_id", "received_ts", "batch_seq", "device", "vw", "referrer", "utm_source",
        "country", "max_q", "score", "band", "contact", "max_scroll", "last_section",
    )


@query
def read_batch_events(spark, folder):
    """Events of the batches that survive the trip, coerced from JSON."""
    return ingest.event_rows(_stored_batches(spark, folder))


@query
def read_batch_clicks(spark, folder):
    return _wide_clicks(ingest.click_rows(_stored_batches(spark, folder)))


@query
def quarantine_batches(spark, folder):
    """Every batch with its verdict; broken bodies are still there to be looked at."""
    marked = ingest.quarantine_batches(_stored_batches(spark, folder))
    return marked.select("batch_seq", "destino", F.startswith("body", F.lit("{oops")).alias("quebrado"))


@query
def read_notifications(spark, folder):
    """Notifications through JSON files, as normalised order messages."""
    path = work_folder(spark, "notifications")
    sample.raw_notifications(spark, folder).write.json(path)
    messages = payload.extract(files.read_notifications(spark, path))
    return messages.withColumn("received_ts", F.col("received_ts").cast("timestamp_ntz"))


@query
def event_log_store(spark, folder):
    """Events stored by day and read back for the period."""
    path = work_folder(spark, "events")
    files.append_events(sample.batches(spark, folder), path)
    stored = files.read_log(spark, path, "events", "timestamp_ntz")
    return period_filter(stored, "ts", **PERIOD).drop("dt")


@query
def event_page(spark, folder):
    """The third page of the stored event log, with the total."""
    path = work_folder(spark, "events")
    files.append_events(sample.batches(spark, folder), path)
    stored = files.read_log(spark, path, "events", "timestamp_ntz")
    return paging.event_page(stored, limit=200, offset=400, **PERIOD).with_numbers()


@query
def session_page(spark, folder):
    sessions = sample.stored(spark, folder).sessions()
    return paging.session_page(sessions, device="mobile", limit=50, offset=100, **PERIOD).with_numbers()


@query
def order_page(spark, folder):
    stored = sample.stored(spark, folder)
    return paging.order_page(stored.orders(), stored.sessions(), "problema", limit=60, offset=60, **PERIOD).with_numbers()


@query
def stream_ingest(spark, folder):
    path = work_folder(spark, "stream-events")
    batches = sample.batches(spark, sample.Live(folder))
    streams.stream_events(batches, f"{path}/rows", f"{path}/checkpoint")
    return files.read_log(spark, f"{path}/rows", "events", "timestamp_ntz").drop("dt")


@query
def stream_click_ingest(spark, folder):
    path = work_folder(spark, "stream-clicks")
    batches = sample.batches(spark, sample.Live(folder))
    streams.stream_clicks(batches, f"{path}/rows", f"{path}/checkpoint")
    return _wide_clicks(files.read_log(spark, f"{path}/rows", "clicks", "timestamp_ntz").drop("dt"))


@query
def stream_json_ingest(spark, folder):
    """Events out of JSON request bodies, followed as a stream of files."""
    path = work_folder(spark, "stream-json")
    batches = files.follow_batches(spark, _batch_files(spark, folder))
    batches = batches.withColumn("received_ts", F.col("received_ts").cast("timestamp_ntz"))
    streams.stream_events(batches, f"{path}/rows", f"{path}/checkpoint")
    return files.read_log(spark, f"{path}/rows", "events", "timestamp_ntz").drop("dt")


@query
def stream_sessions(spark, folder):
    path = work_folder(spark, "stream-sessions")
    batches = sample.batches(spark, sample.Live(folder))
    streams.stream_sessions(batches, f"{path}/states", f"{path}/checkpoint")
    return History(spark, f"{path}/states", folds.sessions()).read()


def _streamed_orders(spark, folder):
    path = work_folder(spark, "stream-orders")
    notes = sample.normalized(sample.flat_notifications(spark, sample.Live(folder)))
    streams.stream_orders(notes, f"{path}/orders", f"{path}/purchases", f"{path}/checkpoint", f"{path}/raws")
    return path


@query
def stream_orders(spark, folder):
    path = _streamed_orders(spark, folder)
    orders = folds.finished_orders(History(spark, f"{path}/orders", folds.orders()).read())
    return folds.with_raw(orders, spark.read.parquet(f"{path}/raws"))


@query
def stream_purchases(spark, folder):
    return History(spark, f"{_streamed_orders(spark, folder)}/purchases", folds.purchases()).read()


@query
def stream_rate_admission(spark, folder):
    calls = sample.calls(spark, sample.Live(folder))
    verdicts = collected(spark, live.stream_rate_admission(calls, limit=3, hours=24), "quota")
    return verdicts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_rage_clicks(spark, folder):
    """Rage clicks of a clock that moves on from visit to visit, whatever the order in which files are read.

    The delay covers the whole clock. A closing click of no visit comes after all others and
    moves the watermark past their minutes, so it closes every visit.
    """
    visit, day = 10_000, 86_400_000     # a visit of the sample is over in less
    start = F.col("session_id").cast("long") * visit + day
    needed = ["session_id", *live.HELD]
    clicks = _labelled_clicks(spark, sample.Live(folder)).withColumn("ts_ms", F.col("ts_ms") + start).select(needed)
    last = sample.clicks_px(spark, folder).agg(F.coalesce(F.max(F.col("ts_ms") + start), F.lit(day))).first()[0]
    path = work_folder(spark, "stream-rage")
    closing = spark.createDataFrame([("", 2 * last + live.PIECE_MS + live.REACH_MS, 0, 0, 0, None, None)], clicks.schema).coalesce(1)
    closing.limit(0).write.parquet(f"{path}/closing")
    every = clicks.unionByName(spark.readStream.schema(clicks.schema).parquet(f"{path}/closing"))
    with keeping_lists(spark):
        found = live.stream_rage_clicks(every, delay=f"{last} milliseconds")
        to_files(found, f"{path}/rows", f"{path}/checkpoint")
        closing.write.mode("append").parquet(f"{path}/closing")
        to_files(found, f"{path}/rows", f"{path}/checkpoint")
    rows = spark.read.schema(found.schema).parquet(f"{path}/rows")
    return rows.withColumn("ts_ms", F.col("ts_ms") - start)


@query
def stream_daily_kpis(spark, folder):
    """The numbers of all days from two streams, the open days marked."""
    path, now = work_folder(spark, "stream-daily"), sample.Live(folder)
    notes = sample.normalized(sample.flat_notifications(spark, now))
    days = streams.stream_daily_kpis(sample.batches(spark, now), notes, path, f"{path}/checkpoint")
    return days.read(delay="10 minutes")


@query
def stream_dedup_sections(spark, folder):
    views = sample.section_views(spark, sample.Live(folder))
    once = collected(spark, live.stream_dedup_sections(views, delay="60 days"), "sections")
    return once.select("session_id", "event_name", "section")


# ------------------------------------------------- small rules, one query each
LOOSE_TEXT = """CASE k % 11 WHEN 0 THEN '7' WHEN 1 THEN ' 12 ' WHEN 2 THEN '' WHEN 3 THEN 'true'
    WHEN 4 THEN 'false' WHEN 5 THEN 'abc' WHEN 6 THEN cast(value AS string) WHEN 7 THEN '0'
    WHEN 9 THEN '1d' WHEN 10 THEN '0x10' END"""


def _keyed(spark, folder, *columns):
    return sample.keyed_events(spark, folder).selectExpr("event_id AS seq", *columns)


@query
def valid_session_id(spark, folder):
    """Ids of many shapes; the usable ones are kept, cut to their width."""
    shapes = """CASE k % 5 WHEN 0 THEN repeat('a', k) WHEN 1 THEN concat('visit_', user_id, '-', k)
        WHEN 2 THEN concat('visita ', user_id) WHEN 3 THEN concat('abcdefgh', chr(10))
        ELSE cast(user_id AS string) END AS sessionId"""
    return ingest.valid_session_id(_keyed(spark, folder, shapes)).select("seq", "session_id")


@query
def event_whitelist(spark, folder):
    """Every event name offered and how many rows of it are stored."""
    offered = sample.flat_batches(spark, folder).select("batch_seq", "event_name")
    kept = F.col("event_name").isin(ingest.ALLOWED_EVENTS)
    return offered.groupBy("event_name").agg(
        v.rows().alias("recebidos"), v.count_where(kept).alias("aceitos")
    )


@query
def step_index(spark, folder):
    events = sample.tables(spark, folder).events
    return events.groupBy("event_name", "step_index").agg(v.rows().alias("n"))


@query
def device_whitelist(spark, folder):
    offered = _keyed(spark, folder, "element_at(array('mobile', 'tablet', 'desktop', 'Mobile', 'tv'), "
                                    "k % 5 + 1) AS device")
    return offered.select("seq", ingest.known_device().alias("device"))


@query
def valid_clicks(spark, folder):
    """Positions outside the page are pulled in; impossible ones drop the click."""
    x = """CASE k % 6 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN NULL
        ELSE value / 100 - 1 END"""
    click = "named_struct('section', 's', 'label', 'l', 'x', %s, 'y', value / 490, 'secPct', " \
            "cast(NULL AS double), 'isCta', true, 'dead', cast(NULL AS boolean), 'band', k %% 7, " \
            "'vw', 1, 'vh', 2)" % x
    batches = sample.keyed_events(spark, folder).selectExpr(
        "event_id AS batch_seq", "ts AS received_ts", "'session-1' AS sessionId", "'tv' AS device",
        f"array({click}) AS clicks",
    )
    return ingest.click_rows(batches).select(
        "id", F.col("x_pct").cast("double").alias("x_pct"),
        F.col("y_pct").cast("double").alias("y_pct"), "is_cta", "dead", "band", "device",
    )


@query
def click_filter(spark, folder):
    clicks = sample.tables(spark, folder).clicks
    chosen = heatmap.click_filter(clicks, device="mobile", band="9", section="preco")
    return chosen.select("id", "device", "section")


@query
def event_log_filter(spark, folder):
    events = sample.tables(spark, folder).events
    return log.event_log_filter(events, name="quiz_answer").select("id", "event_name")


@query
def to_number(spark, folder):
    return _keyed(spark, folder, f"{LOOSE_TEXT} AS text").select(
        "seq", v.to_number(F.col("text")).alias("numero"), v.to_whole(F.col("text")).alias("inteiro")
    )


# a flag as JSON text by k % 16; none at all for the last two
SENT_FLAGS = ['"0"', '"false"', "0", "false", "null", '""', '"x"', '" "', "1.5", "true", "{}", "[]", "0.0", "-1"]


@query
def truthy(spark, folder):
    """A flag of every kind, read from request bodies: once in the snapshot, once in a click."""
    flag = "element_at(array(%s), k %% 16 + 1)" % ", ".join([f"'{text}'" for text in SENT_FLAGS] + ["NULL", "NULL"])
    member = lambda name: f"coalesce(concat('\"{name}\":', {flag}), '')"
    bodies = _keyed(
        spark, folder,
        f"""concat('{{"sessionId":"session-1","session":{{', {member("contact")}, '}},"clicks":[{{"x":0,"y":0', """
        f"""coalesce(concat(',"dead":', {flag}), ''), '}}]}}') AS body""",
    )
    read = ingest.parse_batches(bodies)
    return read.select("seq", F.col("session.contact").alias("ligado"), F.col("clicks")[0]["dead"].alias("morto"))


@query
def clamp01(spark, folder):
    share = _keyed(spark, folder, "CASE WHEN k % 4 <> 0 THEN value / 100 - 1 END AS x")
    return share.select("seq", v.clamp01(F.col("x")).alias("x"))


@query
def clamp_peaks(spark, folder):
    raw = _keyed(spark, folder, "CASE WHEN k % 4 <> 0 THEN (k - 20) * 25 END AS n")
    return raw.select("seq", v.score(F.col("n")).alias("score"), *[
        v.peak(F.col("n"), name).alias(name)
        for name in ("max_q", "max_scroll", "duration_sec", "cta_clicks")
    ])


@query
def valid_band(spark, folder):
    return _keyed(spark, folder, "k % 7 - 1 AS n").select("seq", v.band(F.col("n")).alias("band"))


@query
def day_key(spark, folder):
    return _keyed(spark, folder, "ts").select("seq", v.day_key(F.col("ts")).alias("dia"))


@query
def blank_to_default(spark, folder):
    flat = sample.flat_batches(spark, folder)
    return flat.select("batch_seq", v.blank_to(F.col("utm_source"), "direto").alias("origem"))


@query
def round1(spark, folder):
    """Mean of the value in cents per user, to one decimal."""
    cents = _keyed(spark, folder, "user_id", "cast(round(value * 100) AS bigint) AS cents")
    return cents.groupBy("user_id").agg(v.mean1(F.sum("cents"), F.count("cents")).alias("media"))


@query
def pct1(spark, folder):
    """Share of each user's events that are multiples of three."""
    counted = _keyed(spark, folder, "user_id", "k").groupBy("user_id").agg(
        F.count_if(F.col("k") % 3 == 0).alias("part"), F.count(F.lit(1)).alias("whole")
    )
    return counted.select("user_id", v.pct1(F.col("part"), F.col("whole")).alias("pct"))


@query
def round_ratio(spark, folder):
    orders = sample.table(spark, folder, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return orders.groupBy("o_custkey").agg(v.round_ratio(cents, F.count(F.lit(1))).alias("ticket"))


@query
def cents_to_unit(spark, folder):
    orders = sample.tables(spark, folder).orders
    return orders.select("order_id", v.cents_to_unit(F.col("valor_cents")).alias("valor"))


@query
def grid_cell(spark, folder):
    clicks = sample.tables(spark, folder).clicks
    return clicks.select("id", v.grid_cell(F.col("x_pct"), 60).alias("gx"),
                         v.grid_cell(F.col("y_pct"), 220).alias("gy"))


@query
def natural_question_order(spark, folder):
    """Sections with their number and their place in natural order."""
    sections = sample.tables(spark, folder).events.filter("section IS NOT NULL")
    number = v.question_number(F.col("section"))
    return sections.groupBy("section").agg(F.min(number).alias("numero")).orderBy(
        F.asc_nulls_last("numero"), "section"
    )


@query
def journey_events(spark, folder):
    """The first rows of each visit's timeline, as the screen shows them."""
    return _journey(spark, folder, JOURNEY_LIMITS).filter("kind = 'event'").select(
        "session_id", "pos", "name", "section", "label", "ts"
    )


@query
def journey_clicks_orders(spark, folder):
    return _journey(spark, folder, JOURNEY_LIMITS).filter("kind <> 'event'").select(
        "session_id", "kind", "pos", "name", "status", "valor_cents", "ts"
    )
