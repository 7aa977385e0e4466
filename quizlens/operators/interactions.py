"""Deriving events from raw interaction logs of a page."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quizlens.fixed_values import PRICE_SECTION, SCROLL_MARKS, WIDTH
from quizlens.functions import ordered
from quizlens.functions import values as v

RAGE_PX = 30
RAGE_MS = 1000


def rage_clicks(clicks):
    """The third click of a run of close, quick clicks, once per run.

    A click continues a run when it is within 30 px on both axes and 1 s of the
    previous one. So a third click is one that continues, after one that
    continues, after one that does not: three clicks of look-back, which can
    never reach further than 3 s. Clicks near the end of a minute are therefore
    also given to the next minute, and each (visit, minute) is solved alone.

    Takes ``session_id, seq, ts_ms, client_x, client_y, section, label``; the click's section
    and label go with it.
    """
    minute, reach = 60_000, 3 * RAGE_MS
    own = ordered.piece_of(F.col("ts_ms"), minute)
    near_end = F.col("ts_ms") - own >= minute - reach
    pieces = F.when(near_end, F.array(own, own + minute)).otherwise(F.array(own))
    spread = clicks.withColumn("piece", F.explode(pieces))

    w = Window.partitionBy("session_id", "piece").orderBy("ts_ms", "seq")
    far = lambda c: F.abs(F.col(c) - F.lag(c).over(w)) >= RAGE_PX
    late = F.col("ts_ms") - F.lag("ts_ms").over(w) >= RAGE_MS
    # no previous click at all: the comparison is NULL, and the run starts here
    goes_on = F.coalesce(~(far("client_x") | far("client_y") | late), F.lit(False))
    runs = spread.withColumn("_on", goes_on)
    before = lambda n: F.coalesce(F.lag("_on", n).over(w), F.lit(False))
    third = F.col("_on") & before(1) & ~before(2)
    return (
        runs.withColumn("_third", third)
        .filter(F.col("_third") & (F.col("piece") == own))
        .select("session_id", "ts_ms", "section", "label")
    )


def section_as_of(clicks, views):
    """Clicks with the block they belong to: their own, else the last block seen.

    ``clicks`` have a nullable ``section``; ``views`` are ``session_id, seq,
    ts_ms, section``. A view at the same moment counts as seen before the click.
    """
    columns = [c for c in clicks.columns if c != "section"]
    seen = views.select("session_id", "seq", "ts_ms", F.col("section").alias("_seen"))
    both = clicks.withColumn("_kind", F.lit(1)).unionByName(
        seen.withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    placed = ordered.last_known(
        both.withColumn("piece", ordered.piece_of(F.col("ts_ms"), 60_000)),
        ["session_id"], ["ts_ms", "seq", "_kind"], "_seen", "_last",
    )
    return placed.filter(F.col("_kind") == 1).select(
        *columns, F.coalesce("section", "_last").alias("section")
    )


def scroll_milestones(scrolls):
    """First time each scroll mark was reached, with the block in view then.

    Takes ``session_id, seq, ts, pct, section``. Plain minimums per visit, so a
    busy visit is reduced before the shuffle.
    """
    marks = []
    for mark in SCROLL_MARKS:
        at = F.struct("ts", "seq", "section")
        marks.append(F.min(F.when(F.col("pct") >= mark, at)).alias(f"m{mark}"))
    firsts = scrolls.groupBy("session_id").agg(*marks)
    rows = F.array(*[
        F.struct(F.lit(m).alias("mark"), F.col(f"m{m}").alias("at")) for m in SCROLL_MARKS
    ])
    return (
        firsts.select("session_id", F.inline(rows))
        .filter(F.col("at").isNotNull())
        .select("session_id", "mark", F.col("at.ts").alias("ts"), F.col("at.section").alias("section"))
    )


def first_section_names(firsts):
    """The events of a first view: the view itself and, for the price block, a funnel step."""
    names = F.when(
        F.col("section") == PRICE_SECTION, F.array(F.lit("section_view"), F.lit("offer_view"))
    ).otherwise(F.array(F.lit("section_view")))
    return firsts.select("session_id", F.explode(names).alias("event_name"), "section", "ts")


def first_section_views(views):
    """``section_view`` once per visit and block; the price block is also a funnel step."""
    return first_section_names(views.groupBy("session_id", "section").agg(F.min("ts").alias("ts")))


def _event(name, section, label):
    return F.struct(
        name.alias("event_name"), section.alias("section"), label.alias("label")
    )


def _emit(df, keep, candidates):
    """Unfold the derived events of each row; NULL candidates are dropped."""
    events = F.array_compact(F.array(*candidates))
    return df.select(*keep, F.inline(events))


def quiz_step_events(answers):
    """Events of an answer ``n`` of ten: steps at 1, 5 and 10, the answer, and its topic."""
    none = F.lit(None).cast("string")
    n, question = F.col("n"), F.concat(F.lit("q"), F.col("n").cast("string"))
    step = (
        F.when(n == 1, F.lit("quiz_start")).when(n == 5, F.lit("quiz_half"))
        .when(n == 10, F.lit("quiz_finish"))
    )
    answer = F.lit("quiz_answer")
    result = F.when(F.coalesce("hit", F.lit(False)), F.lit("hit")).otherwise(F.lit("miss"))
    topic = v.cut(F.col("tag"), WIDTH["label"])
    return _emit(answers, ["session_id", "ts"], [
        F.when(step.isNotNull(), _event(step, none, none)),
        _event(answer, question, result),
        F.when(F.coalesce("tag", F.lit("")) != "", _event(answer, question, topic)),
    ])


def click_events(clicks):
    """Funnel events a click causes: buying, leaving for the checkout, opening a question.

    Takes ``session_id, seq, section, label, on_result, is_checkout, tag``. Away
    from the result page only the checkout click counts, and it has no block.
    """
    none = F.lit(None).cast("string")
    section, label = F.col("section"), F.col("label")
    on_result, buys = F.col("on_result"), F.col("is_checkout")
    opens = on_result & ~buys & (F.upper("tag") == "SUMMARY")
    return _emit(clicks, ["session_id", "seq"], [
        F.when(on_result & buys, _event(F.lit("cta_click"), section, label)),
        F.when(buys, _event(F.lit("checkout_click"), F.when(on_result, section).otherwise(none), label)),
        F.when(opens, _event(F.lit("faq_open"), section, label)),
    ])


def page_clicks(clicks):
    """The clicks a heat map is made of: those on the result page, with what they hit.

    A click is dead if nothing at or above its element reacts to clicks. Takes
    ``session_id, seq, section, label, on_result, is_checkout, actionable``.
    """
    return clicks.filter(F.col("on_result")).select(
        "session_id", "seq", "section", v.cut(F.col("label"), WIDTH["label"]).alias("label"),
        F.coalesce("is_checkout", F.lit(False)).alias("is_cta"),
        (~F.coalesce("actionable", F.lit(False))).alias("dead"),
    )


def active_time(log):
    """Seconds each visit's page was visible.

    Takes ``session_id, seq, ts, visible``, a row per change or heartbeat; the
    state of a row lasts until the next one. Each minute is summed alone and
    leaves one row, and the stretches between minutes are added from those.
    """
    order = ["us", "seq"]
    ticks = log.withColumn("us", v.micros(F.col("ts"))).withColumn(
        "piece", ordered.piece_of(F.col("us"))
    )
    inside = Window.partitionBy("session_id", "piece").orderBy(*order)
    across = Window.partitionBy("session_id").orderBy("piece")
    span = F.when(F.col("visible"), F.lead("us").over(inside) - F.col("us"))
    minutes = (
        ticks.withColumn("_span", span)
        .groupBy("session_id", "piece")
        .agg(
            F.coalesce(F.sum("_span"), F.lit(0)).alias("inner"),
            F.min("us").alias("first"),
            F.max("us").alias("last"),
            F.max_by("visible", F.struct(*order)).alias("open"),
        )
    )
    bridge = F.when(F.col("open"), F.lead("first").over(across) - F.col("last"))
    return (
        minutes.withColumn("_bridge", F.coalesce(bridge, F.lit(0)))
        .groupBy("session_id")
        .agg(F.floor(F.sum(F.col("inner") + F.col("_bridge")) / 1_000_000).alias("active_sec"))
    )
