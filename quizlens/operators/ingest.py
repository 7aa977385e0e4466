"""From tracker batches to clean event, click and snapshot rows.

A batch carries ``batch_seq`` and ``received_ts``, the sequence number and the
clock of its arrival; together they are the only order the data has.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens import schemas
from quizlens.fixed_values import (
    DEVICES, ENGAGEMENT_EVENTS, FUNNEL_STEPS, PLACES_PER_BATCH,
    SESSION_ID_PATTERN, WIDTH,
)
from quizlens.functions import values as v

STEP_NAMES = [name for name, _ in FUNNEL_STEPS]
ALLOWED_EVENTS = STEP_NAMES + ENGAGEMENT_EVENTS

ACCEPTED, REFUSED = "aceito", "recusado"


def parse_batches(lines: DataFrame, body="body") -> DataFrame:
    """Parse JSON bodies into typed batches; an unreadable body gives NULL fields and stays beside them.

    Scalars are read as text first and coerced by our own rules, so ``"7"`` and
    ``7`` mean the same. Flags go by the kind of value that was sent (``values.truthy``); a body that
    only the text reader can take, such as one with a member twice, has its flags read from text.
    """
    parsed = lines.withColumn("_b", F.from_json(body, schemas.as_text(schemas.BATCH))).withColumn(
        "_v", F.try_parse_json(body)
    )
    sent = lambda value, name: F.try_variant_get(value, f"$.{name}", "variant")
    flag = lambda text, value, name: F.when(value.isNotNull(), v.truthy(sent(value, name))).otherwise(v.to_flag(text))
    event = lambda e: F.struct(*[e[n].alias(n) for n in ("name", "section", "label")])
    sent_clicks = F.try_variant_get("_v", "$.clicks", "array<variant>")
    click = lambda c, i: F.struct(
        c["section"].alias("section"), c["label"].alias("label"),
        v.to_number(c["x"]).alias("x"), v.to_number(c["y"]).alias("y"),
        v.to_number(c["secPct"]).alias("secPct"),
        *[flag(c[n], F.get(sent_clicks, i), n).alias(n) for n in ("isCta", "dead")],
        *[v.to_whole(c[n]).alias(n) for n in ("band", "vw", "vh")],
    )

    def field(f):
        text, kind = F.col("_b.session")[f.name], f.dataType.simpleString()
        if kind == "boolean":
            return flag(text, sent(F.col("_v"), "session"), f.name).alias(f.name)
        value = v.to_whole(text) if kind == "int" else text
        return (v.or_zero(text, value) if f.name == "score" else value).alias(f.name)

    snapshot = F.struct(*[field(f) for f in schemas.SNAPSHOT_IN.fields])
    return parsed.select(
        *lines.columns,
        F.col("_b.sessionId").alias("sessionId"),
        F.col("_b.device").alias("device"),
        F.transform("_b.events", event).alias("events"),
        F.transform("_b.clicks", click).alias("clicks"),
        F.when(F.col("_b.session").isNotNull(), snapshot).alias("session"),
    )


def with_session_id(batches: DataFrame) -> DataFrame:
    """Add ``session_id``, the id as it was sent: one that is too long is not cut, which could merge two visits."""
    return batches.withColumn("session_id", F.col("sessionId"))


def is_valid_id(column="session_id"):
    return F.coalesce(F.col(column).rlike(SESSION_ID_PATTERN), F.lit(False))


def valid_session_id(batches: DataFrame) -> DataFrame:
    """Keep batches with a usable session id; the others are dropped whole."""
    return with_session_id(batches).filter(is_valid_id())


def quarantine_batches(batches: DataFrame) -> DataFrame:
    """Mark parsed batches as accepted or refused (``destino``) in one pass.

    Refused ones keep their ``body`` and, of broken lines, ``_corrupt_record``, so nothing is lost.
    """
    verdict = F.when(is_valid_id(), ACCEPTED).otherwise(REFUSED)
    return with_session_id(batches).withColumn("destino", verdict)


def known_device(column="device"):
    return v.device(F.col(column), DEVICES)


def step_index(name):
    """Funnel position of an event name; everything else is step 0."""
    places = F.array_position(F.array(*[F.lit(n) for n in STEP_NAMES]), name)
    return F.greatest(places - 1, F.lit(0)).cast("int")


def _leading(column, most):
    return F.col(column) if most is None else F.slice(column, 1, most)


def event_rows(batches: DataFrame, most=None) -> DataFrame:
    """Event rows of the accepted batches, whitelisted and numbered; of each batch the first ``most``, or all."""
    first = _leading("events", most)
    each = valid_session_id(batches).select(
        "batch_seq", "received_ts", "session_id", known_device().alias("device"),
        # an outer one: of the others Spark looks at the array's size first and so derives the array twice
        F.posexplode_outer(first).alias("pos", "e"),
    )
    name = v.cut(F.col("e.name"), WIDTH["event_name"])
    return each.filter(F.col("pos").isNotNull() & name.isin(ALLOWED_EVENTS)).select(
        (F.col("batch_seq") * PLACES_PER_BATCH + F.col("pos")).alias("id"),
        "session_id",
        name.alias("event_name"),
        step_index(name).alias("step_index"),
        v.cut(F.col("e.section"), WIDTH["section"]).alias("section"),
        v.cut(F.col("e.label"), WIDTH["label"]).alias("label"),
        "device",
        F.col("received_ts").alias("ts"),
    )


def click_rows(batches: DataFrame, most=None) -> DataFrame:
    """Click rows of the accepted batches with finite clamped positions; of each batch the first ``most``, or all."""
    first = _leading("clicks", most)
    each = valid_session_id(batches).select(
        "batch_seq", "received_ts", "session_id", known_device().alias("device"),
        F.posexplode_outer(first).alias("pos", "c"),
    )
    x, y = v.clamp01(F.col("c.x")), v.clamp01(F.col("c.y"))
    return each.filter(F.col("pos").isNotNull() & x.isNotNull() & y.isNotNull()).select(
        (F.col("batch_seq") * PLACES_PER_BATCH + F.col("pos")).alias("id"),
        "session_id",
        v.cut(F.col("c.section"), WIDTH["section"]).alias("section"),
        v.cut(F.col("c.label"), WIDTH["label"]).alias("label"),
        x.cast("float").alias("x_pct"),
        y.cast("float").alias("y_pct"),
        v.clamp01(F.col("c.secPct")).cast("float").alias("sec_pct"),
        v.flag(F.col("c.isCta")).alias("is_cta"),
        v.flag(F.col("c.dead")).alias("dead"),
        "device",
        v.band(F.col("c.band")).alias("band"),
        F.col("c.vw").alias("vw"),
        F.col("c.vh").alias("vh"),
        F.col("received_ts").alias("ts"),
    )


def snapshot_rows(batches: DataFrame) -> DataFrame:
    """The session snapshot of each accepted batch, cleaned, one row per batch."""
    s = lambda name: F.col("session")[name]
    text = lambda name, column: v.cut(s(name), WIDTH[column]).alias(column)
    country = F.col("country") if "country" in batches.columns else F.lit(None).cast("string")
    return valid_session_id(batches).filter(F.col("session").isNotNull()).select(
        "session_id", "received_ts", "batch_seq",
        known_device().alias("device"),
        s("vw").alias("vw"),
        text("referrer", "referrer"),
        text("path", "landing_path"),
        *[text(n, n) for n in ("utm_source", "utm_medium", "utm_campaign",
                               "utm_content", "utm_term", "fbclid")],
        v.cut(country, WIDTH["country"]).alias("country"),
        v.peak(s("maxQ"), "max_q").alias("max_q"),
        v.score(s("score")).alias("score"),
        v.band(s("band")).alias("band"),
        v.flag(s("contact")).alias("contact"),
        v.flag(s("reachedResult")).alias("reached_result"),
        v.peak(s("maxScroll"), "max_scroll").alias("max_scroll"),
        v.cut(s("lastSection"), WIDTH["section"]).alias("last_section"),
        v.peak(s("duration"), "duration_sec").alias("duration_sec"),
        v.peak(s("ctaClicks"), "cta_clicks").alias("cta_clicks"),
        v.flag(s("reachedCheckout")).alias("reached_checkout"),
    )
