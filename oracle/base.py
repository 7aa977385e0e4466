"""Shared common table expressions: the derived inputs and the clean tables."""

from quizlens.fixed_values import FUNNEL_STEPS

PERIOD_FROM, PERIOD_TO = "2024-01-05", "2024-01-25"


def period(column):
    return (f"{column} >= DATE '{PERIOD_FROM}' AND "
            f"{column} < DATE '{PERIOD_TO}' + INTERVAL 1 DAY")


KEYED = "keyed AS (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"

NAMES = ([name for name, _ in FUNNEL_STEPS] + ["quiz_answer"] * 3 + "capture_submit capture_skip section_view scroll_25 "
         "scroll_50 scroll_75 scroll_90 faq_open exit not_allowed".split())
STEPS = [name for name, _ in FUNNEL_STEPS]
BLOCKS = ["topo", "preco", "faq", "final"]


def case(index, names):
    return f"list_extract([{', '.join(repr(n) for n in names)}], cast({index} AS INTEGER) + 1)"


FLAT = f"""
flat0 AS (
  SELECT event_id AS batch_seq, ts AS received_ts, k,
    concat('bt', lpad(cast(user_id AS VARCHAR), 6, '0'), 'd202401',
           lpad(cast(extract(day FROM ts) AS VARCHAR), 2, '0')) AS session_id,
    {case('k % 22', NAMES)} AS event_name,
    CASE WHEN k % 22 BETWEEN 9 AND 11 THEN concat('q', 1 + event_id % 10)
         WHEN k % 22 IN (6, 7, 8, 14, 19) AND event_id % 11 <> 0 THEN {case('event_id % 4', BLOCKS)}
    END AS section,
    CASE WHEN k % 22 = 9 THEN 'hit' WHEN k % 22 = 10 THEN 'miss' WHEN k % 22 = 11 THEN 'tema'
         WHEN k % 22 IN (7, 8) AND event_id % 5 <> 0 THEN 'Quero' END AS label,
    320 + cast(floor(value * 3.5) AS INTEGER) AS vw,
    600 + k AS vh, k % 13 AS max_q,
    CASE WHEN k % 5 = 0 THEN k % 12 END AS score, k % 6 AS band,
    k % 7 = 0 AS contact, k > 50 AS reached_result, k >= 80 AS reached_checkout,
    cast(floor(k * 1.2) AS INTEGER) AS max_scroll, cast(floor(value) AS INTEGER) AS duration_sec,
    k % 4 AS cta_clicks,
    CASE user_id % 5 WHEN 0 THEN 'facebook' WHEN 1 THEN 'instagram' WHEN 2 THEN 'google'
                     WHEN 3 THEN '' END AS utm_source,
    CASE user_id % 3 WHEN 0 THEN 'lancamento' WHEN 1 THEN '' END AS utm_campaign,
    CASE k % 3 WHEN 0 THEN 'BR' WHEN 1 THEN 'PT' END AS country,
    CASE WHEN k % 2 = 0 THEN 'https://example.com/' END AS referrer,
    cast((event_id * event_id) % 101 AS DOUBLE) / 100 AS x,
    cast((event_id * event_id) % 401 AS DOUBLE) / 400 AS y,
    CASE WHEN event_id % 3 <> 0 THEN cast((event_id * event_id) % 101 AS DOUBLE) / 100 END AS sec_pct,
    k % 3 = 0 AS is_cta, k % 4 = 0 AS dead
  FROM keyed),
flat AS (
  SELECT *, CASE WHEN vw < 768 THEN 'mobile' WHEN vw < 1024 THEN 'tablet' ELSE 'desktop' END AS device,
    CASE WHEN k % 22 NOT BETWEEN 9 AND 11 THEN section END AS last_section
  FROM flat0)"""

EVENTS = f"""{KEYED}, {FLAT},
ev AS (
  SELECT batch_seq * 1048576 AS id, session_id, event_name,
    cast(greatest(coalesce(list_position([{', '.join(repr(n) for n in STEPS)}], event_name), 0) - 1, 0)
      AS INTEGER) AS step_index,
    section, label, device, received_ts AS ts
  FROM flat WHERE event_name <> 'not_allowed')"""

CLICKS = f"""{KEYED}, {FLAT},
cl AS (
  SELECT batch_seq * 1048576 AS id, session_id, section, label,
    cast(cast(least(1, greatest(0, x)) AS FLOAT) AS DOUBLE) AS x_pct,
    cast(cast(least(1, greatest(0, y)) AS FLOAT) AS DOUBLE) AS y_pct,
    cast(cast(sec_pct AS FLOAT) AS DOUBLE) AS sec_pct,
    is_cta, dead, device, CASE WHEN band BETWEEN 1 AND 4 THEN band END AS band, vw, vh,
    received_ts AS ts
  FROM flat)"""

_FIRST = "first({0} ORDER BY received_ts, batch_seq) AS {0}"
_LAST = "last({0} ORDER BY received_ts, batch_seq) FILTER (WHERE {0} IS NOT NULL) AS {0}"


def _visits(where="true"):
    firsts = ", ".join(_FIRST.format(c) for c in
                       ("device", "vw", "referrer", "utm_source", "utm_campaign", "country"))
    lasts = {c: _LAST.format(c) for c in ("score", "band", "last_section")}
    return f"""
clean AS (
  SELECT session_id, received_ts, batch_seq, device, vw, referrer, utm_source, utm_campaign, country,
    least(10, greatest(0, max_q)) AS max_q, CASE WHEN score IS NOT NULL THEN least(10, score) END AS score,
    CASE WHEN band BETWEEN 1 AND 4 THEN band END AS band, contact, reached_result,
    least(100, max_scroll) AS max_scroll, last_section, least(86400, duration_sec) AS duration_sec,
    least(999, cta_clicks) AS cta_clicks, reached_checkout
  FROM flat WHERE {where}),
v AS (
  SELECT session_id, min(received_ts) AS first_ts, max(received_ts) AS last_ts, {firsts},
    cast(NULL AS VARCHAR) AS utm_medium, cast(NULL AS VARCHAR) AS utm_content,
    cast(NULL AS VARCHAR) AS utm_term, cast(NULL AS VARCHAR) AS fbclid, '/Quiz/' AS landing_path,
    max(max_q) AS max_q, {lasts['score']}, {lasts['band']},
    bool_or(contact) AS contact, bool_or(reached_result) AS reached_result,
    max(max_scroll) AS max_scroll, {lasts['last_section']}, max(duration_sec) AS duration_sec,
    max(cta_clicks) AS cta_clicks, bool_or(reached_checkout) AS reached_checkout
  FROM clean GROUP BY session_id)"""


VISITS = f"{KEYED}, {FLAT}, {_visits()}"

STATUS_RULES = [
    ("(^|_)(paid|approved|aprovad|complet|success|succeed|confirm|pago|authorized)", "pago"),
    ("(refund|estorn|reembols|devolvid)", "estornado"),
    ("(chargeback|charged_back|contestad)", "chargeback"),
    ("(abandon)", "abandonado"),
    ("(refus|denied|declin|reject|recusad|fail|error|erro)", "recusado"),
    ("(cancel|expir|vencid)", "cancelado"),
    ("(pending|pendent|waiting|aguardand|process|created|criad|analis|generated|gerad)", "pendente"),
]


def status(column):
    arms = " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for p, n in STATUS_RULES)
    return f"CASE {arms} END"


NOTES = f"""
notes0 AS (
  SELECT o_orderkey AS seq, o_custkey,
    cast('2024-01-01' AS TIMESTAMP) + (o_orderkey * 7919 % 2592000) * INTERVAL '1' SECOND AS received_ts,
    concat('ord', cast(cast(floor(o_orderkey / 3.0) AS BIGINT) AS VARCHAR)) AS order_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN
      concat('bt', lpad(cast(o_custkey % 150 AS VARCHAR), 6, '0'), 'd202401',
             lpad(cast(1 + o_orderkey % 30 AS VARCHAR), 2, '0')) END AS session_id,
    {case('o_orderkey % 8', ['ORDER_PAID', 'pending', 'refunded', 'chargeback', 'refused',
                             'abandoned_cart', 'expired', 'approved'])} AS status_raw,
    CASE o_orderkey % 4 WHEN 0 THEN '1490' WHEN 1 THEN '14.90' WHEN 2 THEN '14,90'
      ELSE cast(o_totalprice AS VARCHAR) END AS valor_raw
  FROM orders),
notes1 AS (
  SELECT *, CASE WHEN seq % 3 <> 1 THEN status_raw END AS evento,
    CASE WHEN seq % 3 = 1 THEN 'cartao' END AS metodo,
    CASE WHEN seq % 3 = 0 THEN concat('c', o_custkey, '@example.com') END AS cliente_email,
    cast(replace(valor_raw, ',', '.') AS DOUBLE) AS amount,
    CASE seq % 3 WHEN 0 THEN concat('{{"eventType":{{"code":"', status_raw, '"}},"order":{{"id":"', order_id, '","status":"',
        status_raw, '","amount":"', valor_raw, '","customer":{{"email":"c', o_custkey, '@example.com"}}}},"src":"', session_id, '"}}')
      WHEN 1 THEN concat('{{"transaction_id":"', order_id, '","data":{{"payment_status":"', status_raw, '","total_value":"',
        valor_raw, '","payment_method":"CREDIT_CARD"}},"tracking":"', session_id, '"}}')
      ELSE concat('{{"sale":{{"code":"', order_id, '","items":[{{"id":"i1","price":"999"}}],"total":"', valor_raw,
        '"}},"event":"', status_raw, '","note":"sck=', session_id, '&x=1"}}') END AS raw
  FROM notes0),
notes AS (
  SELECT *, {status('status_raw')} AS status,
    cast(floor(CASE WHEN amount <> floor(amount) OR amount < 1000 THEN amount * 100 ELSE amount END
      + 0.5) AS INTEGER) AS valor_cents
  FROM notes1)"""


def _orders(source="notes"):
    known = lambda c: f"last({c} ORDER BY received_ts, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    nothing = ", ".join(f"cast(NULL AS VARCHAR) AS {c}" for c in
                        ("produto", "cliente_nome", "cliente_fone", "utm_source", "utm_campaign"))
    return f"""
o AS (
  SELECT order_id,
    first(session_id ORDER BY received_ts, seq) FILTER (WHERE session_id IS NOT NULL) AS session_id,
    last(status ORDER BY received_ts, seq) AS status,
    {known('evento')}, {known('valor_cents')}, {known('metodo')}, {known('cliente_email')}, {nothing},
    min(received_ts) AS created_at, max(received_ts) AS updated_at,
    min(received_ts) FILTER (WHERE status = 'pago') AS paid_at, 'BRL' AS moeda,
    last(raw ORDER BY received_ts, seq) AS raw
  FROM {source} GROUP BY order_id)"""


ORDERS = f"{NOTES}, {_orders()}"

PURCHASES = """
p AS (
  SELECT session_id, last(status = 'pago' ORDER BY received_ts, seq) AS purchased,
    last(valor_cents ORDER BY received_ts, seq)
      FILTER (WHERE status = 'pago' AND valor_cents IS NOT NULL) AS purchase_cents,
    min(received_ts) FILTER (WHERE status = 'pago') AS purchase_ts
  FROM notes
  WHERE session_id IS NOT NULL AND status IN ('pago', 'estornado', 'chargeback')
  GROUP BY session_id)"""

SESSIONS = f"""{VISITS}, {NOTES}, {PURCHASES},
s AS (
  SELECT v.*, coalesce(p.purchased, false) AS purchased, p.purchase_cents, p.purchase_ts
  FROM v LEFT JOIN p USING (session_id))"""

ALL = f"""{EVENTS}, {CLICKS[len(KEYED) + len(FLAT) + 3:]}, {_visits()}, {NOTES}, {_orders()}, {PURCHASES},
s AS (
  SELECT v.*, coalesce(p.purchased, false) AS purchased, p.purchase_cents, p.purchase_ts
  FROM v LEFT JOIN p USING (session_id))"""


def n(condition=None):
    return "cast(count(*) AS INTEGER)" if condition is None else (
        f"cast(count(*) FILTER (WHERE {condition}) AS INTEGER)")


def distinct(column):
    return f"cast(count(DISTINCT {column}) AS INTEGER)"


def mean1(column, where="true"):
    total = f"sum({column}) FILTER (WHERE {where})"
    count = f"count({column}) FILTER (WHERE {where})"
    return (f"CASE WHEN {count} > 0 THEN floor(cast(20 * {total} + {count} AS DOUBLE) / "
            f"cast(2 * {count} AS DOUBLE)) / 10.0::DOUBLE ELSE 0.0::DOUBLE END")


def pct1(part, whole):
    return (f"CASE WHEN {whole} > 0 THEN floor(cast(2000 * {part} + {whole} AS DOUBLE) / "
            f"cast(2 * {whole} AS DOUBLE)) / 10.0::DOUBLE ELSE 0.0::DOUBLE END")


def money(column, where):
    return f"cast(coalesce(sum({column}) FILTER (WHERE {where}), 0) AS BIGINT)"
