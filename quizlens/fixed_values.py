"""Fixed values of the product's data model.

Every list, label, limit and pattern here is part of the contract between the
quiz page, the checkout and the panel: changing one changes results. They are
kept together so they can be read (and reviewed) in one place.
"""

# --- funnel steps: position in the list is the step number ----------------
FUNNEL_STEPS = [
    ("visit", "Abriu o quiz"),
    ("quiz_start", "Respondeu a 1ª pergunta"),
    ("quiz_half", "Chegou na 5ª"),
    ("quiz_finish", "Respondeu as 10"),
    ("capture_view", "Viu a tela de contato"),
    ("result_view", "Viu o resultado (a oferta)"),
    ("offer_view", "Rolou até o preço"),
    ("cta_click", "Clicou no botão de compra"),
    ("checkout_click", "Foi pro checkout"),
]

# --- engagement events: logged, but they never advance the funnel ---------
ENGAGEMENT_EVENTS = [
    "quiz_answer",
    "capture_submit",
    "capture_skip",
    "section_view",
    "scroll_25",
    "scroll_50",
    "scroll_75",
    "scroll_90",
    "faq_open",
    "rage_click",
    "exit",
]

DEVICES = ["mobile", "tablet", "desktop"]
SCROLL_MARKS = [25, 50, 75, 90]
PRICE_SECTION = "preco"

# --- ingest limits --------------------------------------------------------
MAX_EVENTS_PER_BATCH = 40
MAX_CLICKS_PER_BATCH = 60
PLACES_PER_BATCH = 2**20     # stride of row numbers: room for the rows of one batch
SESSION_ID_PATTERN = r"^[a-zA-Z0-9_-]{8,40}\z"
MAX_RAW_CHARS = 60000
RAW_SUMMARY_CHARS = 4000

# --- text widths of the stored columns ------------------------------------
WIDTH = {
    "session_id": 40,
    "event_name": 60,
    "section": 40,
    "label": 120,
    "referrer": 500,
    "landing_path": 200,
    "utm_source": 120,
    "utm_medium": 120,
    "utm_campaign": 160,
    "utm_content": 160,
    "utm_term": 160,
    "fbclid": 255,
    "country": 2,
    "order_id": 120,
    "evento": 60,
    "metodo": 20,
    "produto": 160,
    "cliente_nome": 160,
    "cliente_email": 160,
    "cliente_fone": 40,
}

# --- upper bounds of the "peak" columns of a session ----------------------
PEAK = {"max_q": 10, "score": 10, "max_scroll": 100, "duration_sec": 86400, "cta_clicks": 999}

# --- retention, in days / hours -------------------------------------------
KEEP_LOG_DAYS = 30
KEEP_SESSION_DAYS = 90
KEEP_CALLS_HOURS = 24
DEFAULT_PERIOD_DAYS = 30

# --- order status: the first pattern that matches wins --------------------
STATUS_PATTERNS = [
    (r"(^|_)(paid|approved|aprovad|complet|success|succeed|confirm|pago|authorized)", "pago"),
    (r"(refund|estorn|reembols|devolvid)", "estornado"),
    (r"(chargeback|charged_back|contestad)", "chargeback"),
    (r"(abandon)", "abandonado"),
    (r"(refus|denied|declin|reject|recusad|fail|error|erro)", "recusado"),
    (r"(cancel|expir|vencid)", "cancelado"),
    (r"(pending|pendent|waiting|aguardand|process|created|criad|analis|generated|gerad)", "pendente"),
]
UNKNOWN_STATUS = "desconhecido"

# --- payment method: the first pattern that matches wins ------------------
METHOD_PATTERNS = [
    (r"pix", "pix"),
    (r"(credit|debit|card|cartao|cartão)", "cartao"),
    (r"(boleto|bank_slip|billet)", "boleto"),
    (r"(paypal)", "paypal"),
]

# --- sale notification: field names by output column, best name first -----
FIELD_NAMES = {
    "evento": ["eventtype", "event", "eventname", "type", "hook", "action", "description", "code"],
    "status": [
        "status", "paymentstatus", "transactionstatus", "orderstatus",
        "situacao", "situation", "state",
    ],
    "valor": [
        "amountcents", "totalcents", "valuecents", "pricecents",
        "totalvalue", "totalamount", "totalprice", "ordertotal", "valortotal",
        "amount", "total", "value", "valor", "price", "paidamount", "netamount",
    ],
    "email": [
        "customeremail", "buyeremail", "clientemail", "clienteemail", "email", "emailaddress",
    ],
    "nome": [
        "customername", "buyername", "clientname", "clientenome", "fullname", "name", "nome",
    ],
    "fone": [
        "customerphone", "buyerphone", "phonenumber", "phone", "celular", "whatsapp", "telefone",
    ],
    "metodo": ["paymentmethod", "paymenttype", "method", "formapagamento", "billingtype"],
    "produto": [
        "productname", "offername", "plancode", "productid", "product", "plano", "produto", "title",
    ],
    "utm_source": ["utmsource", "source", "origem"],
    "utm_campaign": ["utmcampaign", "campaign", "campanha"],
}
ORDER_ID_NAMES = [
    "transactionid", "orderid", "saleid", "paymentid", "checkoutid",
    "orderreference", "externalreference", "ordercode", "transactioncode",
]
GENERIC_ID_NAMES = ["id", "code", "hash", "reference", "uuid"]
ROOT_ID_NAMES = ["id", "hash"]
ORDER_CONTEXT = r"(order|transaction|sale|payment|purchase|checkout|pedido|venda)"
FORBIDDEN_CONTEXT = (
    r"(eventtype|event|product|item|customer|buyer|client|cliente|plan|offer|seller|producer|utm)"
)
SESSION_FIELD_NAMES = [
    "btsid", "sck", "src", "sessionid", "session", "tracking",
    "trackingid", "externalid", "externalreference", "utmcontent",
]
SESSION_IN_TEXT = r"(?i)\bbt[0-9a-z]{12,38}\b"
NO_ID_PREFIX = "sem-id-"

# --- display defaults for missing values ----------------------------------
NO_DEVICE = "desconhecido"
DIRECT = "direto"
DASH = "—"
NO_SECTION = "não registrada"
NO_LABEL = "(sem rótulo)"
DEAD_LABEL = "(área sem ação)"
CTA_LABEL = "CTA"

# --- report sizes ---------------------------------------------------------
TOP = {
    "overview_by_source": 25,
    "offer_abandonment": 20,
    "cta_ranking": 30,
    "element_ranking": 40,
    "dead_clicks": 20,
    "sales_by_source": 12,
    "rescue_list": 40,
}
JOURNEY_LIMITS = {"event": 500, "click": 300, "order": 20}

# --- list arguments: (lowest, highest, default) ---------------------------
LIST_LIMITS = {"events": (10, 300, 150), "sessions": (10, 200, 60), "orders": (10, 300, 100)}
GRID_COLS = (20, 120, 60)
GRID_ROWS = (50, 400, 220)
BANDS = [1, 2, 3, 4]
