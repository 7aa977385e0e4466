"""One SQL text per query name."""

from oracle.base import (
    ALL, BLOCKS, CLICKS, EVENTS, FLAT, KEYED, NOTES, ORDERS, PURCHASES, SESSIONS, STEPS, VISITS,
    case, distinct, mean1, money, n, pct1, period, status,
)

from quizlens.fixed_values import FUNNEL_STEPS

ORACLE_SQL = {}


def add(name, ctes, select):
    ORACLE_SQL[name] = f"WITH {ctes}\n{select}"


E = f"FROM ev WHERE {period('ts')}"
C = f"FROM cl WHERE {period('ts')}"
V = f"FROM v WHERE {period('first_ts')}"
S = f"FROM s WHERE {period('first_ts')}"
O = f"FROM o WHERE {period('created_at')}"

# ------------------------------------------------------------------ overview
add("overview_summary", SESSIONS, f"""
SELECT {n()} AS sessoes, {n('max_q > 0')} AS comecaram, {n('max_q >= 10')} AS terminaram,
  {n('contact')} AS contatos, {n('reached_result')} AS viram_oferta, {n('cta_clicks > 0')} AS com_cta,
  {n('reached_checkout')} AS checkouts, {n('purchased')} AS compras,
  {money('purchase_cents', 'purchased')} AS receita_cents, {n('max_q = 0')} AS saiu_na_cara,
  {mean1('score')} AS nota_media, {mean1('duration_sec')} AS tempo_medio,
  {mean1('max_scroll', 'reached_result')} AS scroll_oferta,
  cast(coalesce(quantile_cont(duration_sec, 0.5), 0) AS DOUBLE) AS tempo_mediano
{S}""")
BY_DAY = f"""
SELECT strftime(first_ts, '%Y-%m-%d') AS dia, {n()} AS sessoes, {n('max_q >= 10')} AS terminaram,
  {n('reached_result')} AS ofertas, {n('reached_checkout')} AS checkouts
{V} GROUP BY 1"""
BY_DEVICE = f"""
SELECT coalesce(device, 'desconhecido') AS device, {n()} AS sessoes, {n('max_q >= 10')} AS terminaram,
  {n('reached_checkout')} AS checkouts, {mean1('duration_sec')} AS tempo_medio
{V} GROUP BY 1"""
BY_SOURCE = f"""
SELECT coalesce(nullif(utm_source, ''), 'direto') AS origem,
  coalesce(nullif(utm_campaign, ''), '—') AS campanha, {n()} AS sessoes,
  {n('max_q >= 10')} AS terminaram, {n('reached_checkout')} AS checkouts
{V} GROUP BY 1, 2 ORDER BY sessoes DESC, origem, campanha LIMIT 25"""
add("overview_by_day", VISITS, BY_DAY)
add("overview_by_device", VISITS, BY_DEVICE)
add("overview_by_source", VISITS, BY_SOURCE)

# -------------------------------------------------------------------- funnel
TOPS = f"{EVENTS}, tops AS (SELECT session_id, max(step_index) AS topo {E} GROUP BY 1)"
LABELS = [label for _, label in FUNNEL_STEPS]
STEP_ROWS = ", ".join(f"({i}, '{k}', '{l}')" for i, (k, l) in enumerate(zip(STEPS, LABELS)))
FUNNEL = f"""{TOPS}, steps(step, key, label) AS (VALUES {STEP_ROWS}),
reached AS (
  SELECT step, key, label, cast(count(topo) AS INTEGER) AS sessoes
  FROM steps LEFT JOIN tops ON topo >= step GROUP BY 1, 2, 3),
lagged AS (
  SELECT *, first_value(sessoes) OVER (ORDER BY step) AS total, lag(sessoes) OVER (ORDER BY step) AS ant
  FROM reached),
funnel AS (
  SELECT key, step, label, sessoes, {pct1('sessoes', 'total')} AS pct_do_topo,
    CASE WHEN ant IS NOT NULL THEN greatest(0, ant - sessoes) END AS perdeu,
    CASE WHEN ant IS NOT NULL THEN {pct1('sessoes', 'ant')} END AS pct_do_anterior
  FROM lagged)"""
add("funnel_top_step", TOPS, f"SELECT topo, {n()} AS sessoes FROM tops GROUP BY 1")
add("funnel_steps", FUNNEL, "SELECT * FROM funnel")
add("funnel_zero_fill", FUNNEL, """
SELECT step, key, cast(count(topo) AS INTEGER) AS sessoes
FROM steps LEFT JOIN tops ON topo = step GROUP BY 1, 2""")
add("funnel_cumulative", FUNNEL, "SELECT step, sessoes FROM funnel")
add("funnel_drop", FUNNEL, "SELECT step, perdeu, pct_do_anterior FROM funnel")
add("bottleneck", FUNNEL, """
SELECT key, step, perdeu FROM funnel WHERE perdeu IS NOT NULL ORDER BY perdeu DESC, step LIMIT 1""")
REACH = f"""SELECT section, {distinct('session_id')} AS sessoes {E}
  AND event_name = 'section_view' AND section IS NOT NULL GROUP BY 1"""
ABANDON = f"""SELECT coalesce(last_section, 'não registrada') AS section, {n()} AS sessoes {V}
  AND reached_result AND NOT reached_checkout GROUP BY 1 ORDER BY sessoes DESC, section LIMIT 20"""
CTAS = f"""SELECT coalesce(section, '—') AS section, coalesce(label, 'CTA') AS label, {n()} AS cliques,
  {distinct('session_id')} AS sessoes {E} AND event_name IN ('cta_click', 'checkout_click')
  GROUP BY 1, 2 ORDER BY cliques DESC, section, label LIMIT 30"""
CAPTURE = f"""SELECT event_name, {distinct('session_id')} AS sessoes {E}
  AND event_name IN ('capture_submit', 'capture_skip') GROUP BY 1"""
add("section_reach", EVENTS, REACH)
add("offer_abandonment", VISITS, ABANDON)
add("cta_ranking", EVENTS, CTAS)
add("capture_outcome", EVENTS, CAPTURE)


# ------------------------------------------------------------------ heat map
def grid(cols, rows, more=""):
    return f"""SELECT cast(least({cols - 1}, floor(x_pct * {cols})) AS INTEGER) AS gx,
  cast(least({rows - 1}, floor(y_pct * {rows})) AS INTEGER) AS gy, {n()} AS n,
  {n('is_cta')} AS n_cta, {n('dead')} AS n_mortos
{C} {more} GROUP BY 1, 2"""


GRID = f"{CLICKS}, grid AS ({grid(60, 220)})"
add("heat_grid", GRID, "SELECT * FROM grid")
add("heat_grid_cut", CLICKS, grid(20, 50, "AND device = 'mobile' AND band = 2 AND section = 'preco'"))
add("heat_totals", GRID, """
SELECT cast(coalesce(max(n), 0) AS INTEGER) AS pico, cast(coalesce(sum(n), 0) AS BIGINT) AS total FROM grid""")
add("heat_intensity", GRID, """
SELECT gx, gy, n, cast(n AS DOUBLE) / cast((SELECT max(n) FROM grid) AS DOUBLE) AS intensity FROM grid""")
add("element_ranking", CLICKS, f"""
SELECT coalesce(label, '(sem rótulo)') AS label, coalesce(section, '—') AS section, {n()} AS cliques,
  {distinct('session_id')} AS sessoes, bool_or(is_cta) AS is_cta
{C} GROUP BY 1, 2 ORDER BY cliques DESC, label, section LIMIT 40""")
add("dead_clicks", CLICKS, f"""
SELECT coalesce(section, '—') AS section, coalesce(label, '(área sem ação)') AS label, {n()} AS cliques,
  {distinct('session_id')} AS sessoes
{C} AND dead GROUP BY 1, 2 ORDER BY cliques DESC, section, label LIMIT 20""")
add("clicks_by_section", CLICKS, f"""
SELECT coalesce(section, '—') AS section, {n()} AS cliques, {n('is_cta')} AS cta, {n('dead')} AS mortos,
  {distinct('session_id')} AS sessoes {C} GROUP BY 1""")


def curve(more=""):
    return f"""SELECT g.d AS ate, cast(count(r.session_id) AS INTEGER) AS sessoes,
  {pct1('count(r.session_id)', '(SELECT count(*) FROM r)')} AS pct
FROM (SELECT cast(unnest(range(10, 101, 10)) AS INTEGER) AS d) g LEFT JOIN r ON r.max_scroll >= g.d
GROUP BY 1"""


add("scroll_curve", f"{VISITS}, r AS (SELECT * {V} AND reached_result)", curve())
add("scroll_curve_cut",
    f"{VISITS}, r AS (SELECT * {V} AND reached_result AND device = 'mobile' AND band = 3)", curve())

# ---------------------------------------------------------------------- quiz
ACCURACY = f"""SELECT section, {n()} AS respostas, {n("label = 'hit'")} AS acertos,
  {n("label = 'miss'")} AS erros {E} AND event_name = 'quiz_answer' AND section IS NOT NULL GROUP BY 1"""
DROPOFF = f"SELECT max_q, {n()} AS sessoes {V} AND max_q < 10 GROUP BY 1"
SCORES = f"""SELECT score, {n()} AS sessoes, {n('cta_clicks > 0')} AS ctas,
  {n('reached_checkout')} AS checkouts {V} AND score IS NOT NULL GROUP BY 1"""
BANDS = f"""SELECT band, {n()} AS sessoes, {n('cta_clicks > 0')} AS ctas,
  {n('reached_checkout')} AS checkouts, {mean1('max_scroll')} AS scroll_medio
  {V} AND band IS NOT NULL GROUP BY 1"""
add("question_accuracy", EVENTS, ACCURACY)
add("quiz_dropoff", VISITS, DROPOFF)
add("score_distribution", VISITS, SCORES)
add("band_distribution", VISITS, BANDS)

# --------------------------------------------------------------------- sales
PAID = "status = 'pago'"
add("orders_summary", ORDERS, f"""
SELECT *, cast(CASE WHEN pagos > 0 THEN floor(cast(receita_cents AS DOUBLE) / cast(pagos AS DOUBLE) + 0.5)
  ELSE 0 END AS BIGINT) AS ticket_cents
FROM (SELECT {n()} AS pedidos, {n(PAID)} AS pagos, {n("status = 'pendente'")} AS pendentes,
  {n("status IN ('estornado', 'chargeback')")} AS estornos,
  {n("status IN ('recusado', 'cancelado')")} AS recusados,
  {n("status = 'abandonado'")} AS abandonados, {money('valor_cents', PAID)} AS receita_cents,
  {n("status = 'pago' AND session_id IS NULL")} AS pagos_sem_vinculo {O})""")
add("checkout_summary", SESSIONS, f"""
SELECT {n('reached_checkout')} AS checkouts, {n('purchased')} AS compraram,
  {n('reached_checkout AND NOT purchased')} AS abandonaram {S}""")
add("sales_by_day", ORDERS, f"""
SELECT strftime(created_at, '%Y-%m-%d') AS dia, {n(PAID)} AS pagos,
  {money('valor_cents', PAID)} AS receita_cents {O} GROUP BY 1""")
BOUGHT = f"{n('purchased')} AS compras, {money('purchase_cents', 'purchased')} AS receita_cents"
add("sales_by_band", SESSIONS, f"""
SELECT band, {n()} AS sessoes, {n('reached_checkout')} AS checkouts, {BOUGHT}
{S} AND band IS NOT NULL GROUP BY 1""")
add("sales_by_source", SESSIONS, f"""
SELECT coalesce(nullif(utm_source, ''), 'direto') AS origem, {n()} AS sessoes, {BOUGHT}
{S} GROUP BY 1 ORDER BY receita_cents DESC, sessoes DESC, origem LIMIT 12""")
JOINED = """SELECT o.order_id, o.session_id, o.status, o.evento, o.valor_cents, o.metodo, o.produto,
  o.cliente_nome, o.cliente_email, o.cliente_fone, o.utm_source, o.utm_campaign, o.created_at, o.paid_at,
  v.score, v.band, v.device, v.max_scroll, v.duration_sec,
  coalesce(o.utm_source, v.utm_source) AS origem, coalesce(o.utm_campaign, v.utm_campaign) AS campanha
FROM o LEFT JOIN v ON v.session_id = o.session_id"""
LINKED = f"{VISITS}, {ORDERS}"
PROBLEM = "status IN ('estornado', 'chargeback', 'recusado', 'cancelado')"
NEWEST = "ORDER BY o.created_at DESC, o.order_id"
add("order_list", LINKED, f"{JOINED} WHERE {period('o.created_at')} {NEWEST} LIMIT 100")
add("order_list_problem", LINKED,
    f"{JOINED} WHERE {period('o.created_at')} AND o.{PROBLEM} {NEWEST} LIMIT 50")
add("orders_with_session", LINKED, JOINED)
add("order_filter", ORDERS, f"SELECT order_id, status FROM o WHERE {PROBLEM}")
add("rescue_list", SESSIONS, f"""
SELECT session_id, first_ts, device, score, band, contact, max_scroll, duration_sec, cta_clicks,
  utm_source, utm_campaign
{S} AND reached_checkout AND NOT purchased ORDER BY contact DESC, first_ts DESC, session_id LIMIT 40""")

# ------------------------------------------------------------ sessions, log
add("session_list", SESSIONS, f"""
SELECT session_id, first_ts, device, max_q, score, band, contact, reached_result, max_scroll,
  last_section, duration_sec, cta_clicks, reached_checkout, utm_source, utm_campaign, country,
  referrer, purchased, purchase_cents
{S} AND cta_clicks > 0 AND NOT reached_checkout AND device = 'mobile'
ORDER BY first_ts DESC, session_id LIMIT 100 OFFSET 20""")
add("session_list_after", SESSIONS, f"""
SELECT session_id, first_ts, device, max_q, score, band, contact, reached_result, max_scroll,
  last_section, duration_sec, cta_clicks, reached_checkout, utm_source, utm_campaign, country,
  referrer, purchased, purchase_cents
{S} AND first_ts < TIMESTAMP '2024-01-20 12:00:00' OR (first_ts = TIMESTAMP '2024-01-20 12:00:00' AND session_id > '')
ORDER BY first_ts DESC, session_id LIMIT 150""")
add("session_count", SESSIONS, f"SELECT {n()} AS n {S} AND reached_checkout AND NOT purchased")
FILTERS = {
    "comprou": "purchased", "nao_comprou": "reached_checkout AND NOT purchased",
    "checkout": "reached_checkout", "cta": "cta_clicks > 0 AND NOT reached_checkout",
    "oferta": "reached_result AND cta_clicks = 0", "largou": "max_q > 0 AND max_q < 10",
    "na_cara": "max_q = 0", "contato": "contact",
}
add("session_filter", SESSIONS,
    "SELECT " + ", ".join(f"{n(c)} AS {k}" for k, c in FILTERS.items()) + " FROM s")
def journey(cut=""):
    nothing = lambda kinds: ", ".join(f"cast(NULL AS {kind})" for kind in kinds.split())
    return f"""
SELECT * FROM (
  SELECT session_id, ts, 'event' AS kind, event_name AS name, section, label, step_index,
    cast(NULL AS DOUBLE) AS x_pct, cast(NULL AS DOUBLE) AS y_pct, cast(NULL AS BOOLEAN) AS is_cta,
    cast(NULL AS VARCHAR) AS status, cast(NULL AS INTEGER) AS valor_cents, cast(NULL AS VARCHAR) AS metodo,
    cast(NULL AS VARCHAR) AS produto, cast(NULL AS VARCHAR) AS cliente_nome, cast(NULL AS VARCHAR) AS cliente_email,
    cast(NULL AS TIMESTAMP) AS paid_at,
    cast(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS INTEGER) AS pos FROM ev
  UNION ALL
  SELECT session_id, ts, 'click', CASE WHEN dead THEN 'dead' ELSE 'click' END, section, label, NULL,
    x_pct, y_pct, is_cta, {nothing("VARCHAR INTEGER VARCHAR VARCHAR VARCHAR VARCHAR TIMESTAMP")},
    cast(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS INTEGER) FROM cl
  UNION ALL
  SELECT session_id, created_at, 'order', order_id, {nothing("VARCHAR VARCHAR INTEGER DOUBLE DOUBLE BOOLEAN")},
    status, valor_cents, metodo, produto, cliente_nome, cliente_email, paid_at,
    cast(row_number() OVER (PARTITION BY session_id ORDER BY created_at, order_id) AS INTEGER)
  FROM o WHERE session_id IS NOT NULL)
WHERE session_id IN (SELECT session_id FROM v) {cut}"""


add("session_journey", ALL, journey())
add("journey_cut", ALL, journey("AND pos <= CASE kind WHEN 'event' THEN 500 WHEN 'click' THEN 300 ELSE 20 END"))
add("events_by_type", EVENTS, f"""
SELECT event_name, {n()} AS n, {distinct('session_id')} AS sessoes, max(ts) AS ultimo {E} GROUP BY 1""")
add("event_count", EVENTS, f"SELECT {n()} AS n {E} AND event_name = 'quiz_answer'")
LOG = "SELECT id, session_id, event_name, step_index, section, label, device, ts"
add("event_log", EVENTS, f"""{LOG} {E} AND event_name = 'cta_click'
ORDER BY ts DESC, id DESC LIMIT 200 OFFSET 100""")
add("event_log_after", EVENTS, f"""{LOG} {E} AND ts < TIMESTAMP '2024-01-20 12:00:00'
ORDER BY ts DESC, id DESC LIMIT 150""")



def paged(rows, order, limit, offset):
    """A page of rows with their number and whether more follow."""
    return (f"SELECT * EXCLUDE (place), total > {offset + limit} AS tem_mais FROM (SELECT *, "
            f"cast(count(*) OVER () AS INTEGER) AS total, row_number() OVER ({order}) AS place FROM ({rows})) "
            f"WHERE place > {offset} AND place <= {offset + limit}")


LISTED = ("session_id, first_ts, device, max_q, score, band, contact, reached_result, max_scroll, last_section, "
          "duration_sec, cta_clicks, reached_checkout, utm_source, utm_campaign, country, referrer, purchased, purchase_cents")
add("event_page", EVENTS, paged(f"SELECT * {E}", "ORDER BY ts DESC, id DESC", 200, 400))
add("session_page", SESSIONS, paged(f"SELECT {LISTED} {S} AND device = 'mobile'", "ORDER BY first_ts DESC, session_id", 50, 100))
add("order_page", LINKED, paged(
    f"{JOINED} WHERE {period('o.created_at')} AND o.{PROBLEM}", "ORDER BY created_at DESC, order_id", 60, 60))


# ------------------------------------------------------------ ingest, folds
add("append_events", EVENTS, "SELECT * FROM ev")
add("append_clicks", CLICKS, "SELECT * FROM cl")
add("batch_caps", f"{KEYED}, {FLAT}", f"""
SELECT concat('btlote', lpad(cast(batch_seq // 64 AS VARCHAR), 8, '0')) AS session_id,
  {n('batch_seq % 64 < 60')} AS cliques,
  nullif({n("batch_seq % 64 < 40 AND event_name <> 'not_allowed'")}, 0) AS eventos
FROM flat GROUP BY 1""")
add("session_fold", VISITS, "SELECT * FROM v")
add("upsert_sessions", VISITS, "SELECT * FROM v")
add("order_fold", ORDERS, "SELECT * FROM o")
add("upsert_orders", ORDERS, "SELECT * FROM o")
add("notifications_to_orders", ORDERS, "SELECT * FROM o")
add("purchase_fold", f"{NOTES}, {PURCHASES}", "SELECT * FROM p")
add("purchase_fold_strict", f"{VISITS}, {NOTES}, " + PURCHASES.replace(
    "FROM notes", "FROM notes JOIN (SELECT session_id, first_ts FROM v) USING (session_id)"
).replace("WHERE session_id IS NOT NULL", "WHERE received_ts >= first_ts"), "SELECT * FROM p")
add("stamp_purchases", SESSIONS, "SELECT * FROM s")
add("retention", ALL, """
SELECT 'events' AS "table", count(*) FILTER (WHERE ts >= e) AS kept,
  count(*) FILTER (WHERE NOT ts >= e) AS dropped FROM ev, (SELECT TIMESTAMP '2024-01-16' AS e)
UNION ALL SELECT 'clicks', count(*) FILTER (WHERE ts >= e), count(*) FILTER (WHERE NOT ts >= e)
  FROM cl, (SELECT TIMESTAMP '2024-01-16' AS e)
UNION ALL SELECT 'sessions', count(*), 0 FROM s
UNION ALL SELECT 'calls', count(*) FILTER (WHERE ts >= TIMESTAMP '2024-02-14'),
  count(*) FILTER (WHERE ts < TIMESTAMP '2024-02-14') FROM events
UNION ALL SELECT 'orders', count(*), 0 FROM o""")
add("retained_sessions", SESSIONS, """
SELECT session_id, first_ts, purchased FROM s WHERE first_ts >= TIMESTAMP '2024-01-16' OR purchased""")
add("evolve_schema", SESSIONS, """
SELECT session_id, purchased AND day(first_ts) >= 10 AS purchased,
  CASE WHEN day(first_ts) >= 10 THEN purchase_cents END AS purchase_cents,
  CASE WHEN day(first_ts) >= 10 THEN purchase_ts END AS purchase_ts FROM s""")
# the columns of each result set of the screens, by name, and the query that has it
SCREEN_SETS = {
    ("overview", "resumo"): ("overview_summary", "checkouts com_cta comecaram compras contatos nota_media receita_cents "
                             "saiu_na_cara scroll_oferta sessoes tempo_mediano tempo_medio terminaram viram_oferta"),
    ("overview", "porDia"): ("overview_by_day", "checkouts dia ofertas sessoes terminaram"),
    ("overview", "porDispositivo"): ("overview_by_device", "checkouts device sessoes tempo_medio terminaram"),
    ("overview", "porOrigem"): ("overview_by_source", "campanha checkouts origem sessoes terminaram"),
    ("funnel", "passos"): ("funnel_steps", "key label pct_do_anterior pct_do_topo perdeu sessoes step"),
    ("funnel", "secoes"): ("section_reach", "section sessoes"),
    ("funnel", "abandono"): ("offer_abandonment", "section sessoes"),
    ("funnel", "ctas"): ("cta_ranking", "cliques label section sessoes"),
    ("funnel", "captura"): ("capture_outcome", "event_name sessoes"),
    ("heatmap", "celulas"): ("heat_grid", "gx gy n n_cta n_mortos"),
    ("heatmap", "grade"): ("heat_totals", "pico total"),
    ("heatmap", "elementos"): ("element_ranking", "cliques is_cta label section sessoes"),
    ("heatmap", "mortos"): ("dead_clicks", "cliques label section sessoes"),
    ("heatmap", "porSecao"): ("clicks_by_section", "cliques cta mortos section sessoes"),
    ("heatmap", "rolagem"): ("scroll_curve", "ate pct sessoes"),
    ("quiz", "perguntas"): ("question_accuracy", "acertos erros respostas section"),
    ("quiz", "abandono"): ("quiz_dropoff", "max_q sessoes"),
    ("quiz", "notas"): ("score_distribution", "checkouts ctas score sessoes"),
    ("quiz", "faixas"): ("band_distribution", "band checkouts ctas scroll_medio sessoes"),
    ("sales", "resumo"): ("orders_summary", "abandonados estornos pagos pagos_sem_vinculo pedidos pendentes receita_cents "
                          "recusados ticket_cents"),
    ("sales", "checkout"): ("checkout_summary", "abandonaram checkouts compraram"),
    ("sales", "porDia"): ("sales_by_day", "dia pagos receita_cents"),
    ("sales", "pedidos"): ("order_list", "band campanha cliente_email cliente_fone cliente_nome created_at device "
                           "duration_sec evento max_scroll metodo order_id origem paid_at produto score session_id status "
                           "utm_campaign utm_source valor_cents"),
    ("sales", "abandonos"): ("rescue_list", "band contact cta_clicks device duration_sec first_ts max_scroll score "
                             "session_id utm_campaign utm_source"),
    ("sales", "porFaixa"): ("sales_by_band", "band checkouts compras receita_cents sessoes"),
    ("sales", "porOrigem"): ("sales_by_source", "compras origem receita_cents sessoes"),
    ("sessions", "total"): ("all_sessions", "n"),
    ("sessions", "sessoes"): ("first_sessions", "band contact country cta_clicks device duration_sec first_ts last_section "
                              "max_q max_scroll purchase_cents purchased reached_checkout reached_result referrer score "
                              "session_id utm_campaign utm_source"),
    ("events", "porTipo"): ("events_by_type", "event_name n sessoes ultimo"),
    ("events", "total"): ("all_events", "n"),
    ("events", "eventos"): ("first_events", "device event_name id label section session_id step_index ts"),
}


def bundle():
    parts = []
    for (screen, name), (query, columns) in SCREEN_SETS.items():
        row = ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in columns.split())
        parts.append(f"""SELECT '{screen}' AS tela, '{name}' AS bloco, {n()} AS linhas,
  coalesce(sum(('0x' || substr(md5(concat_ws('|', {row})), 1, 8))::BIGINT), 0)::BIGINT AS conteudo FROM ({ORACLE_SQL[query]})""")
    return " UNION ALL ".join(parts)


ORACLE_SQL["period_filter"] = f"""
SELECT 'both' AS form, {n()} AS n FROM events WHERE {period('ts')}
UNION ALL SELECT 'from_only', {n()} FROM events WHERE ts >= DATE '2024-01-05'
UNION ALL SELECT 'to_only', {n()} FROM events WHERE ts > TIMESTAMP '2024-01-16'
UNION ALL SELECT 'none', {n()} FROM events WHERE ts > TIMESTAMP '2024-01-16'"""

# -------------------------------------------------------------- interactions
GROUP20 = "cast(cast(floor(event_id / 20.0) AS BIGINT) AS VARCHAR)"
TS_MS = "(event_id % 20) * 400 + ((k * 7) % 5) * 150"
SECTION3 = "CASE event_id % 4 WHEN 0 THEN 'topo' WHEN 1 THEN 'preco' WHEN 2 THEN 'faq' END"
PX = f"""{KEYED}, px AS (
  SELECT {GROUP20} AS session_id, event_id AS seq, {TS_MS} AS ts_ms, 100 + (k % 3) * 20 AS client_x,
    100 AS client_y, {SECTION3} AS section, k % 4 <> 0 AS actionable, k % 10 = 0 AS is_checkout,
    CASE WHEN k % 10 = 5 THEN 'SUMMARY' ELSE 'A' END AS tag, event_id % 7 <> 0 AS on_result
  FROM keyed)"""
add("rage_clicks", f"""{PX},
gaps AS (SELECT *, lag(client_x) OVER w AS lx, lag(client_y) OVER w AS ly, lag(ts_ms) OVER w AS lt
  FROM px WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, seq)),
runs AS (SELECT *, sum(CASE WHEN abs(client_x - lx) < 30 AND abs(client_y - ly) < 30
    AND ts_ms - lt < 1000 THEN 0 ELSE 1 END)
  OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
places AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY ts_ms, seq) AS place FROM runs)
""", "SELECT session_id, ts_ms, section, concat('b', seq) AS label FROM places WHERE place = 3")
add("section_as_of", f"""{PX},
seen AS (SELECT {GROUP20} AS session_id, event_id AS seq, {TS_MS} AS ts_ms,
  {case('k % 4', BLOCKS)} AS seen FROM keyed WHERE k % 5 = 0),
both_kinds AS (
  SELECT session_id, seq, ts_ms, 1 AS kind, client_x, client_y, actionable, is_checkout, tag, on_result,
    section, NULL AS seen FROM px
  UNION ALL SELECT session_id, seq, ts_ms, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, seen FROM seen),
filled AS (SELECT * EXCLUDE (section, seen), coalesce(section, last_value(seen IGNORE NULLS) OVER (
    PARTITION BY session_id ORDER BY ts_ms, seq, kind ROWS UNBOUNDED PRECEDING)) AS section FROM both_kinds)
""", "SELECT * EXCLUDE (kind) FROM filled WHERE kind = 1")
add("scroll_milestones", f"""{KEYED},
scrolls AS (SELECT {GROUP20} AS session_id, event_id AS seq, ts, k AS pct, {SECTION3} AS section FROM keyed),
crossings AS (SELECT session_id, mark, ts, section,
    row_number() OVER (PARTITION BY session_id, mark ORDER BY ts, seq) AS place
  FROM scrolls JOIN (SELECT cast(unnest([25, 50, 75, 90]) AS INTEGER) AS mark) ON pct >= mark)
""", "SELECT session_id, mark, ts, section FROM crossings WHERE place = 1")
add("first_section_views", f"""{KEYED},
firsts AS (SELECT cast(user_id AS VARCHAR) AS session_id, {case('k % 4', BLOCKS)} AS section, min(ts) AS ts
  FROM keyed GROUP BY 1, 2)""", """
SELECT session_id, 'section_view' AS event_name, section, ts FROM firsts
UNION ALL SELECT session_id, 'offer_view', section, ts FROM firsts WHERE section = 'preco'""")
add("quiz_step_events", f"""{KEYED},
a AS (SELECT cast(cast(floor(event_id / 10.0) AS BIGINT) AS VARCHAR) AS session_id, ts,
  1 + event_id % 10 AS n, k % 3 <> 0 AS hit, CASE WHEN k % 2 = 0 THEN 'tema' END AS tag FROM keyed)""", """
SELECT session_id, CASE n WHEN 1 THEN 'quiz_start' WHEN 5 THEN 'quiz_half' ELSE 'quiz_finish' END AS event_name,
  cast(NULL AS VARCHAR) AS section, cast(NULL AS VARCHAR) AS label, ts FROM a WHERE n IN (1, 5, 10)
UNION ALL SELECT session_id, 'quiz_answer', concat('q', n), CASE WHEN hit THEN 'hit' ELSE 'miss' END, ts FROM a
UNION ALL SELECT session_id, 'quiz_answer', concat('q', n), tag, ts FROM a WHERE tag IS NOT NULL""")
add("click_events", PX, """
SELECT session_id, seq, 'cta_click' AS event_name, section, concat('b', seq) AS label
  FROM px WHERE on_result AND is_checkout
UNION ALL SELECT session_id, seq, 'checkout_click', CASE WHEN on_result THEN section END, concat('b', seq)
  FROM px WHERE is_checkout
UNION ALL SELECT session_id, seq, 'faq_open', section, concat('b', seq)
  FROM px WHERE on_result AND NOT is_checkout AND tag = 'SUMMARY'""")
add("page_clicks", PX, """
SELECT session_id, seq, section, concat('b', seq) AS label, is_checkout AS is_cta, NOT actionable AS dead
FROM px WHERE on_result""")
add("active_time", f"""{KEYED},
spans AS (SELECT cast(user_id AS VARCHAR) AS session_id,
  CASE WHEN k % 3 <> 0 THEN epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
    - epoch_us(ts) END AS us FROM keyed)""", """
SELECT session_id, cast(coalesce(sum(us), 0) AS BIGINT) // 1000000 AS active_sec FROM spans GROUP BY 1""")
ORACLE_SQL["trailing_calls"] = """
SELECT cast(user_id AS VARCHAR) AS key, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS n FROM events"""

# ------------------------------------------------------------ browser values
PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid"]
ORACLE_SQL["utm_params"] = "SELECT page_id, " + ", ".join(
    f"CASE WHEN regexp_matches(url, '[?&]{p}=') THEN url_decode(replace("
    f"regexp_extract(url, '[?&]{p}=([^&#]*)', 1), '+', ' ')) END AS {p}" for p in PARAMS) + " FROM pages"
add("device_class", f"{KEYED}, {FLAT}", "SELECT batch_seq, device FROM flat")
POINTER = f"""{KEYED}, px AS (SELECT event_id AS seq, cast(floor(value) AS INTEGER) AS client_x,
  cast(event_id % 700 AS INTEGER) AS client_y, cast(k * 37 + event_id % 700 AS INTEGER) AS page_y,
  cast((event_id % 50) * 10 AS INTEGER) AS ww, 700 AS wh, (k % 9) * 500 AS dh, k * 5 AS bt,
  (k % 8) * 60 AS bh, k * 33 AS sy FROM keyed)"""
add("norm_click_xy", POINTER, """
SELECT seq, least(1.0, greatest(0.0, cast(client_x AS DOUBLE) / CASE WHEN ww > 0 THEN ww ELSE 1 END)) AS x,
  least(1.0, greatest(0.0, cast(page_y AS DOUBLE) / greatest(dh, wh, 1))) AS y,
  CASE WHEN bh > 0 THEN least(1.0, greatest(0.0, cast(client_y - bt AS DOUBLE) / bh)) END AS sec_pct FROM px""")
add("scroll_pct", POINTER, """
SELECT seq, CASE WHEN dh - wh > 0 THEN cast(least(100,
  floor(cast(sy AS DOUBLE) / (dh - wh) * 100.0::DOUBLE + 0.5::DOUBLE)) AS INTEGER) END AS pct FROM px""")
WS = (r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
ORACLE_SQL["clean_label"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'cta-topo' END AS track,
  CASE WHEN doc_id % 11 = 2 THEN 'Comprar' END AS aria, doc_id % 7 = 0 AS img,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS alt,
  CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS text FROM documents)
SELECT doc_id, substring(coalesce(track, aria, CASE WHEN img THEN coalesce(nullif(alt, ''), 'imagem') END,
  nullif(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g'), ''),
  CASE WHEN img THEN 'img' ELSE 'div' END), 1, 120) AS label FROM d"""

# --------------------------------------------------------- texts and amounts
ORACLE_SQL["truncate_text"] = """
SELECT doc_id, substring(text, 1, 120) AS rotulo, nullif(substring(text, 1, 40), '') AS fone,
  coalesce(nullif(source, ''), 'direto') AS origem FROM documents"""
ORACLE_SQL["normalize_key"] = """
SELECT doc_id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS source,
  regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS text FROM documents"""
ORACLE_SQL["order_key_fallback"] = """
SELECT doc_id, concat('sem-id-', substring(sha1(text), 1, 24)) AS order_id FROM documents"""
ORACLE_SQL["extract_session_id"] = """
SELECT doc_id, nullif(regexp_extract(CASE WHEN doc_id % 3 = 0
  THEN concat(text, ' sck=btabcdefghijk', doc_id, '&x=1') ELSE text END,
  '(?i)\\bbt[0-9a-z]{12,38}\\b', 0), '') AS session_id FROM documents"""
add("normalize_amount", NOTES,
    "SELECT seq, valor_cents, cast(valor_cents AS DOUBLE) / 100.0::DOUBLE AS valor FROM notes")
add("normalize_status", NOTES, "SELECT seq, status FROM notes")
ORACLE_SQL["normalize_method"] = """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'boleto'
  ELSE lower(substring(o_orderpriority, 1, 20)) END AS metodo FROM orders"""
add("order_id_resolution", NOTES, "SELECT seq, order_id FROM notes")
add("session_link", NOTES, "SELECT seq, session_id FROM notes")
add("first_by_name", NOTES, """
SELECT seq, 'evento' AS field, CASE WHEN seq % 3 = 0 THEN 'code' ELSE 'event' END AS key,
  status_raw AS value FROM notes WHERE seq % 3 <> 1
UNION ALL SELECT seq, 'status', CASE WHEN seq % 3 = 0 THEN 'status' ELSE 'paymentstatus' END, status_raw
  FROM notes WHERE seq % 3 <> 2
UNION ALL SELECT seq, 'valor', CASE seq % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'totalvalue' ELSE 'total' END,
  valor_raw FROM notes
UNION ALL SELECT seq, 'email', 'email', cliente_email FROM notes WHERE seq % 3 = 0
UNION ALL SELECT seq, 'metodo', 'paymentmethod', 'CREDIT_CARD' FROM notes WHERE seq % 3 = 1""")
add("payload_leaves", f"""{NOTES},
leaf AS (
  SELECT seq, unnest(CASE seq % 3
    WHEN 0 THEN [
      {{'ord': 0, 'key': 'code', 'path': 'eventtype.code', 'value': status_raw}},
      {{'ord': 1, 'key': 'id', 'path': 'order.id', 'value': order_id}},
      {{'ord': 2, 'key': 'status', 'path': 'order.status', 'value': status_raw}},
      {{'ord': 3, 'key': 'amount', 'path': 'order.amount', 'value': valor_raw}},
      {{'ord': 4, 'key': 'email', 'path': 'order.customer.email', 'value': cliente_email}},
      {{'ord': 5, 'key': 'src', 'path': 'src', 'value': coalesce(session_id, '')}}]
    WHEN 1 THEN [
      {{'ord': 0, 'key': 'transactionid', 'path': 'transactionid', 'value': order_id}},
      {{'ord': 1, 'key': 'paymentstatus', 'path': 'data.paymentstatus', 'value': status_raw}},
      {{'ord': 2, 'key': 'totalvalue', 'path': 'data.totalvalue', 'value': valor_raw}},
      {{'ord': 3, 'key': 'paymentmethod', 'path': 'data.paymentmethod', 'value': 'CREDIT_CARD'}},
      {{'ord': 4, 'key': 'tracking', 'path': 'tracking', 'value': coalesce(session_id, '')}}]
    ELSE [
      {{'ord': 0, 'key': 'code', 'path': 'sale.code', 'value': order_id}},
      {{'ord': 1, 'key': 'id', 'path': 'sale.items.id', 'value': 'i1'}},
      {{'ord': 2, 'key': 'price', 'path': 'sale.items.price', 'value': '999'}},
      {{'ord': 3, 'key': 'total', 'path': 'sale.total', 'value': valor_raw}},
      {{'ord': 4, 'key': 'event', 'path': 'event', 'value': status_raw}},
      {{'ord': 5, 'key': 'note', 'path': 'note',
        'value': concat('sck=', coalesce(session_id, ''), '&x=1')}}] END) AS l
  FROM notes)""", """
SELECT seq, l.ord AS ord, l.key AS key, l.path AS path, l.value AS value, true AS is_text FROM leaf""")

# --------------------------------------------------------- files and streams
OK_BODY = "batch_seq % 50 <> 3 AND batch_seq % 40 <> 7"
add("read_batches", VISITS, f"""
SELECT session_id, received_ts, batch_seq, device, vw, referrer, utm_source, country, max_q, score,
  band, contact, max_scroll, last_section FROM clean WHERE {OK_BODY}""")
OK_ID = "(id // 1048576) % 50 <> 3 AND (id // 1048576) % 40 <> 7"
add("read_batch_events", EVENTS, f"SELECT * FROM ev WHERE {OK_ID}")
add("read_batch_clicks", CLICKS, f"SELECT * FROM cl WHERE {OK_ID}")
add("stream_json_ingest", EVENTS, f"SELECT * FROM ev WHERE {OK_ID}")
add("stream_click_ingest", CLICKS, "SELECT * FROM cl")
ORACLE_SQL["quarantine_batches"] = """
SELECT event_id AS batch_seq, CASE WHEN event_id % 50 <> 3 AND event_id % 40 <> 7 THEN 'aceito'
  ELSE 'recusado' END AS destino, event_id % 50 = 3 AS quebrado FROM events"""
add("read_notifications", NOTES, """
SELECT seq, received_ts, order_id, session_id, status, evento, valor_cents, metodo, cast(NULL AS VARCHAR) AS produto,
  cast(NULL AS VARCHAR) AS cliente_nome, cliente_email, cast(NULL AS VARCHAR) AS cliente_fone,
  cast(NULL AS VARCHAR) AS utm_source, cast(NULL AS VARCHAR) AS utm_campaign, raw FROM notes""")
add("event_log_store", EVENTS, f"SELECT * {E}")
add("stream_ingest", EVENTS, "SELECT * FROM ev")
add("stream_sessions", VISITS, "SELECT * FROM v")
add("stream_orders", ORDERS, "SELECT * FROM o")
add("stream_purchases", f"{NOTES}, {PURCHASES}", "SELECT * FROM p")
ORACLE_SQL["stream_rage_clicks"] = ORACLE_SQL["rage_clicks"]
add("stream_daily_kpis", f"""{VISITS}, {ORDERS},
days AS (SELECT first_ts::DATE AS dt, {n()} AS sessoes, {n('max_q >= 10')} AS terminaram,
    {n('reached_result')} AS ofertas, {n('reached_checkout')} AS checkouts FROM v GROUP BY 1),
sales AS (SELECT created_at::DATE AS dt, {n("status = 'pago'")} AS pagos,
    {money('valor_cents', "status = 'pago'")} AS receita_cents FROM o GROUP BY 1),
seen AS (SELECT greatest((SELECT max(ts) FROM events), (SELECT max(received_ts) FROM notes)) AS ts)""", """
SELECT strftime(dt, '%Y-%m-%d') AS dia, coalesce(sessoes, 0) AS sessoes, coalesce(terminaram, 0) AS terminaram,
  coalesce(ofertas, 0) AS ofertas, coalesce(checkouts, 0) AS checkouts, coalesce(pagos, 0) AS pagos,
  coalesce(receita_cents, 0)::BIGINT AS receita_cents, dt >= (ts - INTERVAL 10 MINUTE)::DATE AS provisorio
FROM days FULL JOIN sales USING (dt), seen""")
add("stream_dedup_sections", f"""{KEYED},
firsts AS (SELECT DISTINCT cast(user_id AS VARCHAR) AS session_id, {case('k % 4', BLOCKS)} AS section
  FROM keyed)""", """
SELECT session_id, 'section_view' AS event_name, section FROM firsts
UNION ALL SELECT session_id, 'offer_view', section FROM firsts WHERE section = 'preco'""")

# the quota: every call of a key decided after the one before it
ADMISSION = """
WITH RECURSIVE c AS (
  SELECT cast(user_id AS VARCHAR) AS key, ts, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT key, i, ts, true AS allow, cast(1 AS BIGINT) AS count, [us] AS admitted FROM c WHERE i = 1
  UNION ALL
  SELECT key, i, ts, len(kept) < 3, cast(CASE WHEN len(kept) < 3 THEN len(kept) + 1 ELSE 3 END AS BIGINT),
    CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END
  FROM (SELECT c.key, c.i, c.ts, c.us, list_filter(r.admitted, lambda x: x > c.us - 86400000000) AS kept
        FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1))
SELECT key, ts, allow, count FROM r"""
ORACLE_SQL["rate_admission"] = ADMISSION
ORACLE_SQL["stream_rate_admission"] = ADMISSION
ORACLE_SQL["cap_raw"] = """
SELECT doc_id, cast(length(raw) AS INTEGER) AS tamanho, md5(raw) AS digest FROM (
  SELECT doc_id, CASE WHEN length(text) > 60000 THEN cast(to_json({'_truncado': true,
    'tamanho': length(text), 'inicio': substring(text, 1, 4000)}) AS VARCHAR) ELSE text END AS raw
  FROM documents)"""

# ------------------------------------------------- small rules, one query each
TEXT = f"""{KEYED}, t AS (SELECT event_id AS seq, CASE k % 11 WHEN 0 THEN '7' WHEN 1 THEN ' 12 ' WHEN 2 THEN ''
  WHEN 3 THEN 'true' WHEN 4 THEN 'false' WHEN 5 THEN 'abc' WHEN 6 THEN cast(value AS VARCHAR)
  WHEN 7 THEN '0' WHEN 9 THEN '1d' WHEN 10 THEN '0x10' END AS text FROM keyed),
num AS (SELECT seq, text, CASE text WHEN '' THEN 0.0::DOUBLE WHEN 'true' THEN 1.0::DOUBLE
  WHEN 'false' THEN 0.0::DOUBLE WHEN '0x10' THEN 16.0::DOUBLE ELSE TRY_CAST(trim(text) AS DOUBLE) END AS n FROM t)"""
add("valid_session_id", f"""{KEYED}, ids AS (SELECT event_id AS seq, CASE k % 5
  WHEN 0 THEN repeat('a', k) WHEN 1 THEN concat('visit_', user_id, '-', k) WHEN 2 THEN concat('visita ', user_id)
  WHEN 3 THEN concat('abcdefgh', chr(10)) ELSE cast(user_id AS VARCHAR) END AS session_id FROM keyed)""",
    "SELECT * FROM ids WHERE regexp_matches(session_id, '^[a-zA-Z0-9_-]{8,40}\\z')")
add("event_whitelist", f"{KEYED}, {FLAT}", f"""
SELECT event_name, {n()} AS recebidos, {n("event_name <> 'not_allowed'")} AS aceitos FROM flat GROUP BY 1""")
add("step_index", EVENTS, f"SELECT event_name, step_index, {n()} AS n FROM ev GROUP BY 1, 2")
add("device_whitelist", KEYED, """
SELECT event_id AS seq, CASE k % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'desktop' END AS device
FROM keyed""")
add("valid_clicks", KEYED, """
SELECT event_id * 1048576 AS id, cast(cast(least(1, greatest(0, value / 100 - 1)) AS FLOAT) AS DOUBLE) AS x_pct,
  cast(cast(least(1, greatest(0, value / 490)) AS FLOAT) AS DOUBLE) AS y_pct, true AS is_cta, false AS dead,
  CASE WHEN k % 7 BETWEEN 1 AND 4 THEN k % 7 END AS band, cast(NULL AS VARCHAR) AS device
FROM keyed WHERE k % 6 > 2""")
add("click_filter", CLICKS, """
SELECT id, device, section FROM cl WHERE device = 'mobile' AND section = 'preco'""")
add("event_log_filter", EVENTS, "SELECT id, event_name FROM ev WHERE event_name = 'quiz_answer'")
add("to_number", TEXT, """
SELECT seq, n AS numero, CASE WHEN n = floor(n) THEN cast(n AS INTEGER) END AS inteiro FROM num""")
SENT = ", ".join(f"'{t}'" for t in ('"0"', '"false"', '0', 'false', 'null', '""', '"x"', '" "', '1.5', 'true', '{}', '[]',
                                    '0.0', '-1'))
add("truthy", f"""{KEYED},
sent AS (SELECT event_id AS seq, list_extract([{SENT}], k % 16 + 1) AS flag FROM keyed),
meant AS (SELECT seq, CASE WHEN flag IS NULL OR flag IN ('null', 'false') THEN false
    WHEN flag[1] = '"' THEN flag <> '""' WHEN flag[1] IN ('{{', '[') OR flag = 'true' THEN true
    ELSE flag::DOUBLE <> 0 END AS ligado FROM sent)""", "SELECT seq, ligado, ligado AS morto FROM meant")
add("clamp01", KEYED, """
SELECT event_id AS seq, CASE WHEN k % 4 <> 0 THEN least(1, greatest(0, value / 100 - 1)) END AS x FROM keyed""")
add("clamp_peaks", f"{KEYED}, r AS (SELECT event_id AS seq, CASE WHEN k % 4 <> 0 THEN (k - 20) * 25 END AS n "
    "FROM keyed)", """
SELECT seq, CASE WHEN n IS NOT NULL THEN least(10, greatest(0, n)) END AS score,
  least(10, greatest(0, coalesce(n, 0))) AS max_q, least(100, greatest(0, coalesce(n, 0))) AS max_scroll,
  least(86400, greatest(0, coalesce(n, 0))) AS duration_sec, least(999, greatest(0, coalesce(n, 0))) AS cta_clicks
FROM r""")
add("valid_band", KEYED, """
SELECT event_id AS seq, CASE WHEN k % 7 - 1 BETWEEN 1 AND 4 THEN k % 7 - 1 END AS band FROM keyed""")
ORACLE_SQL["day_key"] = "SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') AS dia FROM events"
add("blank_to_default", f"{KEYED}, {FLAT}",
    "SELECT batch_seq, coalesce(nullif(utm_source, ''), 'direto') AS origem FROM flat")
ORACLE_SQL["round1"] = f"""
SELECT user_id, {mean1('cents')} AS media
FROM (SELECT user_id, cast(round(value * 100) AS BIGINT) AS cents FROM events) GROUP BY 1"""
add("pct1", KEYED, f"""
SELECT user_id, {pct1('count(*) FILTER (WHERE k % 3 = 0)', 'count(*)')} AS pct FROM keyed GROUP BY 1""")
ORACLE_SQL["round_ratio"] = """
SELECT o_custkey, cast(floor(cast(sum(cast(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
  / cast(count(*) AS DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS ticket FROM orders GROUP BY 1"""
add("cents_to_unit", ORDERS, "SELECT order_id, cast(valor_cents AS DOUBLE) / 100.0::DOUBLE AS valor FROM o")
add("grid_cell", CLICKS, """
SELECT id, cast(least(59, floor(x_pct * 60)) AS INTEGER) AS gx,
  cast(least(219, floor(y_pct * 220)) AS INTEGER) AS gy FROM cl""")
add("natural_question_order", EVENTS, """
SELECT section, TRY_CAST(nullif(regexp_replace(section, '[^0-9]', '', 'g'), '') AS INTEGER) AS numero
FROM ev WHERE section IS NOT NULL GROUP BY 1""")
add("all_sessions", SESSIONS, f"SELECT {n()} AS n {S}")
add("first_sessions", SESSIONS, f"SELECT * {S} ORDER BY first_ts DESC, session_id LIMIT 60")
add("all_events", EVENTS, f"SELECT {n()} AS n {E}")
add("first_events", EVENTS, f"SELECT * {E} ORDER BY ts DESC, id DESC LIMIT 150")
ORACLE_SQL["panel_bundle"] = bundle()
for helper in ("all_sessions", "first_sessions", "all_events", "first_events"):
    ORACLE_SQL.pop(helper)
add("session_store", SESSIONS, f"""
SELECT strftime(first_ts, '%Y-%m-%d') AS dia, device, {n()} AS sessoes, {n('purchased')} AS compras,
  cast(sum(purchase_cents) AS BIGINT) AS receita_cents {S} GROUP BY 1, 2""")
ORACLE_SQL["order_store"] = ORACLE_SQL["sales_by_day"]
JOURNEY = ORACLE_SQL.pop("journey_cut")
ORACLE_SQL["journey_events"] = (
    f"SELECT session_id, pos, name, section, label, ts FROM ({JOURNEY}) WHERE kind = 'event'")
ORACLE_SQL["journey_clicks_orders"] = (
    f"SELECT session_id, kind, pos, name, status, valor_cents, ts FROM ({JOURNEY}) WHERE kind <> 'event'")
