"""Funnel inputs derived from generic ``events``, ``orders``, ``pages`` and ``documents``.

The engine needs tracker batches, sale notifications and raw interaction logs.
These expressions derive them, row by row, from a star schema with an event
stream, so every query runs over whole tables of any size. No step shuffles.
"""

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import functions as F

from quizlens import Tables
from quizlens.fixed_values import ENGAGEMENT_EVENTS, FUNNEL_STEPS
from quizlens.functions import sales
from quizlens.functions.values import cut_or_null
from quizlens.schemas import SNAPSHOT_IN
from quizlens.session import work_folder
from quizlens.sources import files
from quizlens.sources.storage import Folder
from quizlens.tables import Stored

# event name by k % 22; the last one is not a known event and must be dropped
EVENT_BY_K = (
    [name for name, _ in FUNNEL_STEPS] + ["quiz_answer"] * 3 + ENGAGEMENT_EVENTS[1:9]
    + ["exit", "not_allowed"]
)
STATUS_BY_SEQ = ["ORDER_PAID", "pending", "refunded", "chargeback",
                 "refused", "abandoned_cart", "expired", "approved"]


@dataclass(frozen=True)
class Live:
    """A folder whose tables are read as streams, a file per micro-batch.

    A table may be one file or several (``events.parquet``, ``events-1.parquet``);
    ``like`` is a folder with the same tables, to take the schema from.
    """

    folder: str
    like: str = None


def table(spark, folder, name):
    if isinstance(folder, Live):
        schema = table(spark, folder.like or folder.folder, name).schema
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        return files.option("pathGlobFilter", f"{name}*.parquet").parquet(folder.folder)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_events(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "*", "cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k"
    )


def pick(names, index):
    """SQL for names[index]."""
    listed = ", ".join(f"'{name}'" for name in names)
    return f"element_at(array({listed}), cast({index} AS int) + 1)"


BLOCK = pick(["topo", "preco", "faq", "final"], "event_id % 4")
BLOCK_BY_K = pick(["topo", "preco", "faq", "final"], "k % 4")
THREE_BLOCKS = "CASE event_id % 4 WHEN 0 THEN 'topo' WHEN 1 THEN 'preco' WHEN 2 THEN 'faq' END"
WIDTH_PX = "320 + cast(floor(value * 3.5) AS int)"
SECTION = f"""
    CASE WHEN k % 22 BETWEEN 9 AND 11 THEN concat('q', 1 + event_id % 10)
         WHEN k % 22 IN (6, 7, 8, 14, 19) AND event_id % 11 <> 0 THEN {BLOCK} END"""
X = "cast((event_id * event_id) % 101 AS double) / 100"

# flat batches: one event, one click and one snapshot per row of ``events``
FLAT = {
    "batch_seq": "event_id",
    "received_ts": "ts",
    "session_id": "concat('bt', lpad(cast(user_id AS string), 6, '0'), 'd202401', "
                  "lpad(cast(day(ts) AS string), 2, '0'))",
    "device": f"CASE WHEN {WIDTH_PX} < 768 THEN 'mobile' WHEN {WIDTH_PX} < 1024 THEN 'tablet' "
              "ELSE 'desktop' END",
    "event_name": pick(EVENT_BY_K, "k % 22"),
    "section": SECTION,
    "label": "CASE WHEN k % 22 = 9 THEN 'hit' WHEN k % 22 = 10 THEN 'miss' "
             "WHEN k % 22 = 11 THEN 'tema' "
             "WHEN k % 22 IN (7, 8) AND event_id % 5 <> 0 THEN 'Quero' END",
    "vw": WIDTH_PX,
    "vh": "600 + k",
    "max_q": "k % 13",
    "score": "CASE WHEN k % 5 = 0 THEN k % 12 END",
    "band": "k % 6",
    "contact": "k % 7 = 0",
    "reached_result": "k > 50",
    "reached_checkout": "k >= 80",
    "max_scroll": "cast(floor(k * 1.2) AS int)",
    "last_section": f"CASE WHEN k % 22 NOT BETWEEN 9 AND 11 THEN {SECTION} END",
    "duration_sec": "cast(floor(value) AS int)",
    "cta_clicks": "k % 4",
    "utm_source": "CASE user_id % 5 WHEN 0 THEN 'facebook' WHEN 1 THEN 'instagram' "
                  "WHEN 2 THEN 'google' WHEN 3 THEN '' END",
    "utm_campaign": "CASE user_id % 3 WHEN 0 THEN 'lancamento' WHEN 1 THEN '' END",
    "country": "CASE k % 3 WHEN 0 THEN 'BR' WHEN 1 THEN 'PT' END",
    "referrer": "CASE WHEN k % 2 = 0 THEN 'https://example.com/' END",
    "x": X,
    "y": "cast((event_id * event_id) % 401 AS double) / 400",
    "sec_pct": f"CASE WHEN event_id % 3 <> 0 THEN {X} END",
    "is_cta": "k % 3 = 0",
    "dead": "k % 4 = 0",
}

# members of a batch by the name the tracker sends, from the flat columns
EVENT = {"name": "event_name", "section": "section", "label": "label"}
CLICK = {
    "section": "section", "label": "label", "x": "x", "y": "y", "secPct": "sec_pct",
    "isCta": "is_cta", "dead": "dead", "band": "band", "vw": "vw", "vh": "vh",
}
SNAPSHOT = {
    "vw": "vw", "referrer": "referrer", "path": None, "utm_source": "utm_source",
    "utm_medium": None, "utm_campaign": "utm_campaign", "utm_content": None, "utm_term": None,
    "fbclid": None, "maxQ": "max_q", "score": "score", "band": "band", "contact": "contact",
    "reachedResult": "reached_result", "maxScroll": "max_scroll", "lastSection": "last_section",
    "duration": "duration_sec", "ctaClicks": "cta_clicks", "reachedCheckout": "reached_checkout",
}


def _named(members):
    """SQL for a struct of the flat columns under the tracker's names."""
    missing = {"path": "'/Quiz/'"}
    parts = [
        f"'{name}', {FLAT[column] if column else missing.get(name, 'cast(NULL AS string)')}"
        for name, column in members.items()
    ]
    return f"named_struct({', '.join(parts)})"


def flat_batches(spark, folder):
    return keyed_events(spark, folder).selectExpr(*[f"{sql} AS {n}" for n, sql in FLAT.items()])


def batches(spark, folder):
    """Batches as the tracker would send them, one event, click and snapshot each."""
    return keyed_events(spark, folder).selectExpr(
        "event_id AS batch_seq", "ts AS received_ts", f"{FLAT['session_id']} AS sessionId",
        f"{FLAT['device']} AS device", f"{FLAT['country']} AS country",
        f"array({_named(EVENT)}) AS events", f"array({_named(CLICK)}) AS clicks",
        f"{_named(SNAPSHOT)} AS session",
    )


def big_batches(spark, folder, size=64):
    """Batches of ``size`` consecutive events, more than an ingest accepts."""
    numbered = keyed_events(spark, folder).selectExpr(
        f"event_id div {size} AS batch_seq", "ts",
        f"named_struct('n', event_id, 'e', {_named(EVENT)}, 'c', {_named(CLICK)}) AS item",
    )
    gathered = numbered.groupBy("batch_seq").agg(
        F.min("ts").alias("received_ts"), F.array_sort(F.collect_list("item")).alias("items")
    )
    return gathered.selectExpr(
        "batch_seq", "received_ts",
        "concat('btlote', lpad(cast(batch_seq AS string), 8, '0')) AS sessionId",
        "'mobile' AS device", "cast(NULL AS string) AS country",
        "items.e AS events", "items.c AS clicks",
        f"cast(NULL AS {SNAPSHOT_IN.simpleString()}) AS session",
    )


def batch_bodies(spark, folder):
    """The batches as JSON request bodies; every 50th is not JSON, and every 40th
    carries an id with a character no session id has."""
    sent = batches(spark, folder).selectExpr(
        "batch_seq", "received_ts", "country",
        """named_struct('sessionId', concat(sessionId, CASE WHEN batch_seq % 40 = 7 THEN '!'
           ELSE '' END), 'device', device, 'events', events, 'clicks', clicks,
           'session', session) AS sent""",
    )
    return sent.selectExpr(
        "batch_seq", "received_ts", "country",
        "concat(CASE WHEN batch_seq % 50 = 3 THEN '{oops' ELSE '' END, to_json(sent)) AS body",
    )


# flat notifications, three per order, as extracted but not yet normalised
NOTE = {
    "seq": "o_orderkey",
    "received_ts": "cast('2024-01-01' AS timestamp_ntz) "
                   "+ (o_orderkey * 7919 % 2592000) * INTERVAL '1' SECOND",
    "order_id": "concat('ord', cast(cast(floor(o_orderkey / 3.0D) AS bigint) AS string))",
    "session_id": "CASE WHEN o_orderkey % 4 <> 0 THEN concat('bt', "
                  "lpad(cast(o_custkey % 150 AS string), 6, '0'), 'd202401', "
                  "lpad(cast(1 + o_orderkey % 30 AS string), 2, '0')) END",
    "status_raw": pick(STATUS_BY_SEQ, "o_orderkey % 8"),
    "valor_raw": "CASE o_orderkey % 4 WHEN 0 THEN '1490' WHEN 1 THEN '14.90' "
                 "WHEN 2 THEN '14,90' ELSE cast(o_totalprice AS string) END",
    "valor_key": pick(["amount", "totalvalue", "total"], "o_orderkey % 3"),
    "evento_raw": f"CASE WHEN o_orderkey % 3 <> 1 THEN {pick(STATUS_BY_SEQ, 'o_orderkey % 8')} END",
    "metodo_raw": "CASE WHEN o_orderkey % 3 = 1 THEN 'CREDIT_CARD' END",
    "email": "CASE WHEN o_orderkey % 3 = 0 THEN concat('c', o_custkey, '@example.com') END",
}

# three JSON shapes of the same notification, by seq % 3
SHAPES = [
    """concat('{"eventType":{"code":"', status_raw, '"},"order":{"id":"', order_id,
       '","status":"', status_raw, '","amount":"', valor_raw, '","customer":{"email":"', email,
       '"}},"src":"', coalesce(session_id, ''), '"}')""",
    """concat('{"transaction_id":"', order_id, '","data":{"payment_status":"', status_raw,
       '","total_value":"', valor_raw, '","payment_method":"CREDIT_CARD"},"tracking":"',
       coalesce(session_id, ''), '"}')""",
    """concat('{"sale":{"code":"', order_id, '","items":[{"id":"i1","price":"999"}],"total":"',
       valor_raw, '"},"event":"', status_raw, '","note":"sck=', coalesce(session_id, ''),
       '&x=1"}')""",
]
PAYLOAD = f"CASE seq % 3 WHEN 0 THEN {SHAPES[0]} WHEN 1 THEN {SHAPES[1]} ELSE {SHAPES[2]} END"


def flat_notifications(spark, folder):
    return table(spark, folder, "orders").selectExpr(*[f"{sql} AS {n}" for n, sql in NOTE.items()])


def normalized(flat):
    """Flat notifications with the normalised columns of an order."""
    none = F.lit(None).cast("string")
    found = F.coalesce(sales.status(F.col("status_raw")),
                       sales.status(F.col("evento_raw")), F.lit("desconhecido"))
    return flat.select(
        "seq", "received_ts", "order_id", "session_id",
        found.alias("status"),
        cut_or_null(F.col("evento_raw"), 60).alias("evento"),
        sales.amount_cents(F.col("valor_key"), F.col("valor_raw")).alias("valor_cents"),
        sales.method(F.col("metodo_raw")).alias("metodo"),
        none.alias("produto"), none.alias("cliente_nome"),
        F.col("email").alias("cliente_email"), none.alias("cliente_fone"),
        none.alias("utm_source"), none.alias("utm_campaign"), F.expr(PAYLOAD).alias("raw"),
    )


def raw_notifications(spark, folder):
    """Notifications as JSON text in three shapes."""
    return flat_notifications(spark, folder).selectExpr("seq", "received_ts", f"{PAYLOAD} AS payload")


def tables(spark, folder):
    return Tables(batches(spark, folder), normalized(flat_notifications(spark, folder)))


def late(number):
    """Every third message comes with the second delivery."""
    return F.pmod(number, F.lit(3)) == 2


@lru_cache(maxsize=4)
def _stored(spark, folder, application, signature):
    stored, t = Stored(spark, work_folder(spark, "stored")), tables(spark, folder)
    for second in (False, True):
        stored.add(t.batches.where(late(F.col("batch_seq")) == second), t.notifications.where(late(F.col("seq")) == second))
    return stored


def stored(spark, folder):
    """The keyed tables of a folder, stored in two deliveries; made once for the files as they are."""
    files = Folder(spark, folder)
    signature = tuple(files.signature(f"{name}.parquet{below}") for name in ("events", "orders") for below in ("", "/*"))
    return _stored(spark, folder, spark.sparkContext.applicationId, signature)


# ---------------------------------------------------------------- raw logs
GROUP_OF_20 = "cast(cast(floor(event_id / 20.0D) AS bigint) AS string) AS session_id"
GROUP_OF_10 = "cast(cast(floor(event_id / 10.0D) AS bigint) AS string) AS session_id"
BY_USER = "cast(user_id AS string) AS session_id"
TS_MS = "(event_id % 20) * 400 + ((k * 7) % 5) * 150 AS ts_ms"
SEQ = "event_id AS seq"


def clicks_px(spark, folder):
    """Raw clicks in pixels, twenty per visit."""
    return keyed_events(spark, folder).selectExpr(
        GROUP_OF_20, SEQ, TS_MS, "100 + (k % 3) * 20 AS client_x", "100 AS client_y",
        f"{THREE_BLOCKS} AS section", "k % 4 <> 0 AS actionable", "k % 10 = 0 AS is_checkout",
        "CASE WHEN k % 10 = 5 THEN 'SUMMARY' ELSE 'A' END AS tag", "event_id % 7 <> 0 AS on_result",
    )


def section_views_px(spark, folder):
    """Moments a block came into view, on the clock of ``clicks_px``."""
    return keyed_events(spark, folder).filter("k % 5 = 0").selectExpr(
        GROUP_OF_20, SEQ, TS_MS, f"{BLOCK_BY_K} AS section"
    )


def scroll_log(spark, folder):
    return keyed_events(spark, folder).selectExpr(
        GROUP_OF_20, SEQ, "ts", "k AS pct", f"{THREE_BLOCKS} AS section"
    )


def section_views(spark, folder):
    return keyed_events(spark, folder).selectExpr(BY_USER, SEQ, "ts", f"{BLOCK_BY_K} AS section")


def answers(spark, folder):
    return keyed_events(spark, folder).selectExpr(
        GROUP_OF_10, SEQ, "ts", "cast(1 + event_id % 10 AS int) AS n", "k % 3 <> 0 AS hit",
        "CASE WHEN k % 2 = 0 THEN 'tema' END AS tag",
    )


def visibility_log(spark, folder):
    return keyed_events(spark, folder).selectExpr(BY_USER, SEQ, "ts", "k % 3 <> 0 AS visible")


def calls(spark, folder):
    return table(spark, folder, "events").selectExpr("cast(user_id AS string) AS key", SEQ, "ts")


def pointer(spark, folder):
    """Raw geometry of clicks: window, document and block sizes in pixels."""
    return keyed_events(spark, folder).selectExpr(
        SEQ, "cast(floor(value) AS int) AS client_x", "cast(event_id % 700 AS int) AS client_y",
        "cast(k * 37 + event_id % 700 AS int) AS page_y",
        "cast((event_id % 50) * 10 AS int) AS window_width", "700 AS window_height",
        "(k % 9) * 500 AS document_height", "k * 5 AS block_top", "(k % 8) * 60 AS block_height",
        "k * 33 AS scroll_y",
    )


@dataclass(frozen=True)
class Shown:
    """What screens read: stored sessions, orders and logs."""

    events: object
    clicks: object
    sessions: object
    orders: object

    @property
    def visits(self):
        return self.sessions


def shown(spark, folder):
    """The stored tables of a folder. Events and clicks are derived once, not anew by each set that reads them."""
    keyed, path, logs = stored(spark, folder), work_folder(spark, "logs"), tables(spark, folder)
    files.write_log(logs.events, f"{path}/events")
    files.write_log(logs.clicks, f"{path}/clicks")
    ts = logs.events.schema["ts"].dataType.simpleString()
    return Shown(
        files.read_log(spark, f"{path}/events", "events", ts), files.read_log(spark, f"{path}/clicks", "clicks", ts),
        keyed.sessions(), keyed.orders(),
    )
