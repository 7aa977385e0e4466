"""What each screen returns: its result sets under their names."""

from functools import reduce

from pyspark.sql import functions as F

from quizlens.plans import funnel, heatmap, log, overview, quiz, sales, visits


def screens(tables, cuts=None, listing=None, tops=None, limits=None, **period):
    """Screen name -> result-set name -> DataFrame, all for one period.

    ``cuts`` are the click filters, ``listing`` the arguments of all lists, ``limits`` the lengths of
    the lists by name, ``tops`` those of rankings (such as ``fixed_values.TOP``; whole without). The
    DataFrames are lazy; a caller that shows whole screens should persist (or
    store) ``tables`` first, since many sets read the same one.
    """
    cuts, listing, tops = cuts or {}, listing or {}, tops or {}
    top = lambda name: {"most": tops.get(name)}
    listed = lambda name: listing | ({"limit": limits[name]} if limits and name in limits else {})
    t = tables
    visible = {k: cuts[k] for k in ("device", "band") if k in cuts}
    grid = heatmap.heat_grid(t.clicks, cuts=cuts, **period)
    return {
        "overview": {
            "resumo": overview.overview_summary(t.sessions, **period),
            "porDia": overview.overview_by_day(t.visits, **period),
            "porDispositivo": overview.overview_by_device(t.visits, **period),
            "porOrigem": overview.overview_by_source(t.visits, **top("overview_by_source"), **period),
        },
        "funnel": {
            "passos": funnel.funnel_steps(t.events, **period),
            "secoes": funnel.section_reach(t.events, **period),
            "abandono": funnel.offer_abandonment(t.visits, **top("offer_abandonment"), **period),
            "ctas": funnel.cta_ranking(t.events, **top("cta_ranking"), **period),
            "captura": funnel.capture_outcome(t.events, **period),
        },
        "heatmap": {
            "celulas": grid,
            "grade": heatmap.heat_totals(grid),
            "elementos": heatmap.element_ranking(t.clicks, cuts=cuts, **top("element_ranking"), **period),
            "mortos": heatmap.dead_clicks(t.clicks, cuts=cuts, **top("dead_clicks"), **period),
            "porSecao": heatmap.clicks_by_section(t.clicks, cuts=cuts, **period),
            "rolagem": heatmap.scroll_curve(t.visits, **visible, **period),
        },
        "quiz": {
            "perguntas": quiz.question_accuracy(t.events, **period),
            "abandono": quiz.quiz_dropoff(t.visits, **period),
            "notas": quiz.score_distribution(t.visits, **period),
            "faixas": quiz.band_distribution(t.visits, **period),
        },
        "sales": {
            "resumo": sales.orders_summary(t.orders, **period),
            "checkout": sales.checkout_summary(t.sessions, **period),
            "porDia": sales.sales_by_day(t.orders, **period),
            "pedidos": sales.order_list(t.orders, t.visits, **listed("orders"), **period),
            "abandonos": sales.rescue_list(t.sessions, **top("rescue_list"), **period),
            "porFaixa": sales.sales_by_band(t.sessions, **period),
            "porOrigem": sales.sales_by_source(t.sessions, **top("sales_by_source"), **period),
        },
        "sessions": {
            "total": visits.session_count(t.sessions, **period),
            "sessoes": visits.session_list(t.sessions, **listed("sessions"), **period),
        },
        "events": {
            "porTipo": log.events_by_type(t.events, **period),
            "total": log.event_count(t.events, **period),
            "eventos": log.event_log(t.events, **listed("events"), **period),
        },
    }


def as_documents(sets):
    """A screen as rows ``bloco, pos, conteudo``: one row of JSON per row of each result set.

    Rows are numbered in no particular order; nothing is gathered, so sets may be of any size.
    """
    documents = [
        df.select(F.lit(name).alias("bloco"), F.monotonically_increasing_id().alias("pos"),
                  F.to_json(F.struct(*df.columns)).alias("conteudo"))
        for name, df in sets.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), documents)


def _content(df):
    """A number that any change of a row's values changes: a digest of each row, summed."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(df.columns)))
    digest = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.sum(digest), F.lit(0))


def result_contents(tables, path, **args):
    """Rows and a digest of the contents of every result set of every screen.

    Screens are counted one after the other, and their rows (one a set) kept below ``path``: the plans of all sets
    at once take more of the driver than it may have.
    """
    kept = []
    for screen, sets in screens(tables, **args).items():
        parts = [
            df.agg(F.lit(screen).alias("tela"), F.lit(name).alias("bloco"),
                   F.count(F.lit(1)).cast("int").alias("linhas"), _content(df).alias("conteudo"))
            for name, df in sets.items()
        ]
        kept.append(f"{path}/{screen}")
        reduce(lambda a, b: a.unionByName(b), parts).write.parquet(kept[-1])
    return tables.events.sparkSession.read.parquet(*kept)
