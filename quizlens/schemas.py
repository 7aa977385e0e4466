"""Explicit schemas of everything the engine reads or stores."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, INT, LONG, DOUBLE, FLAG = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
)

EVENT_IN = _struct(name=TEXT, section=TEXT, label=TEXT)
CLICK_IN = _struct(
    section=TEXT, label=TEXT, x=DOUBLE, y=DOUBLE, secPct=DOUBLE,
    isCta=FLAG, dead=FLAG, band=INT, vw=INT, vh=INT,
)
SNAPSHOT_IN = _struct(
    vw=INT, referrer=TEXT, path=TEXT,
    utm_source=TEXT, utm_medium=TEXT, utm_campaign=TEXT, utm_content=TEXT, utm_term=TEXT,
    fbclid=TEXT, maxQ=INT, score=INT, band=INT, contact=FLAG, reachedResult=FLAG,
    maxScroll=INT, lastSection=TEXT, duration=INT, ctaClicks=INT, reachedCheckout=FLAG,
)
BATCH = _struct(
    sessionId=TEXT, device=TEXT,
    events=T.ArrayType(EVENT_IN), clicks=T.ArrayType(CLICK_IN), session=SNAPSHOT_IN,
)


def as_text(schema):
    """The same shape with every scalar read as text, so that a number sent as
    a string (or the reverse) is coerced by our rules and not refused by the reader."""
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(as_text(schema.elementType))
    return T.StringType()


def events(ts):
    return _struct(id=LONG, session_id=TEXT, event_name=TEXT, step_index=INT,
                   section=TEXT, label=TEXT, device=TEXT, ts=ts)


def clicks(ts):
    return _struct(id=LONG, session_id=TEXT, section=TEXT, label=TEXT,
                   x_pct=T.FloatType(), y_pct=T.FloatType(), sec_pct=T.FloatType(),
                   is_cta=FLAG, dead=FLAG, device=TEXT, band=INT, vw=INT, vh=INT, ts=ts)


def notifications(ts):
    return _struct(seq=LONG, received_ts=ts, payload=TEXT)


def calls(ts):
    return _struct(key=TEXT, ts=ts)
