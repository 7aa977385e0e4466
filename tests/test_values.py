"""Hand-worked values, read off the product's rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizlens.functions import browser, sales
from quizlens.functions import values as v
from quizlens.functions.period import click_args, grid_args, list_args, period_filter


def test_amounts(column):
    cases = [
        ("amount", "14,90", 1490), ("amount", "14.90", 1490), ("amount", "1490", 1490),
        ("amount", "15", 1500), ("amountcents", "15", 15), ("amount", "1490.00", 1490),
        ("amount", "1.234,56", 123456), ("amount", "1,234.56", 123), ("amount", "1,2,3", None),
        ("amount", "abc", None), ("amount", "1.234", 123), ("amount", "R$ 15", 1500),
        ("amount", "-5", -500), ("amount", "", None), ("amount", None, None),
        (None, "15", 1500), ("amount", "999999999999", None), ("pricecents", "14.6", 15),
    ]
    got = column(sales.amount_cents, [c[:2] for c in cases], "k string, t string")
    assert got == [c[2] for c in cases]


def test_statuses(column):
    cases = {
        "ORDER_PAID": "pago", "order.paid": None, "unpaid": None, "refunded": "estornado",
        "refund_confirmed": "pago", "expired": "cancelado", "Charged_Back": "chargeback",
        "cart_abandoned": "abandonado", "DECLINED": "recusado", "waiting_payment": "pendente",
        "": None, None: None,
    }
    assert column(sales.status, [(c,) for c in cases], "t string") == list(cases.values())


def test_methods(column):
    cases = {"CREDIT_CARD": "cartao", "bank_slip": "boleto", "Wire": "wire", "PIX": "pix",
             "PayPal": "paypal", "Uma Forma Muito Comprida": "uma forma muito comp", "": None}
    assert column(sales.method, [(c,) for c in cases], "t string") == list(cases.values())


def test_session_id_in_text(column):
    cases = {
        "x?sck=btabcdefghijklm9&y=1": "btabcdefghijklm9", "BTABCDEFGHIJKL": "BTABCDEFGHIJKL",
        "btshort": None, "xbtabcdefghijklm9": None, "bt" + "a" * 39: None,
        "bt" + "a" * 38: "bt" + "a" * 38, "": None,
    }
    assert column(sales.session_in_text, [(c,) for c in cases], "t string") == list(cases.values())


def test_cap_raw(column):
    short, long = "x" * 60000, "y" * 60001
    kept, cut = column(sales.cap_raw, [(short,), (long,)], "t string")
    assert kept == short
    assert cut == '{"_truncado":true,"tamanho":60001,"inicio":"' + "y" * 4000 + '"}'


def test_device_class(column):
    assert column(browser.device_class, [(767,), (768,), (1023,), (1024,)], "w int") == [
        "mobile", "tablet", "tablet", "desktop"
    ]


def test_query_params(column):
    urls = {
        "https://a.b/c?utm_source=x+y%20z&utm_source=second": "x y z",
        "https://a.b/c?xutm_source=no": None, "https://a.b/c#?utm_source=no": None,
        "https://a.b/c?k=1&utm_source=": "", "/relative?utm_source=ok#top": "ok",
        "https://a.b/?utm_source=100%": "100%",
    }
    got = column(lambda u: browser.query_param(u, "utm_source"), [(u,) for u in urls], "u string")
    assert got == list(urls.values())


def test_labels(column):
    rows = [
        ("buy", "aria", "A", None, "text"), ("", "aria", "A", None, "text"),
        (None, None, "IMG", "", "text"), (None, None, "IMG", "alt", ""),
        (None, None, "DIV", None, "   two\n\t  words　"), (None, None, "DIV", None, "  "),
        (None, None, "P", None, "z" * 300),
    ]
    got = column(browser.clean_label, rows, "a string, b string, c string, d string, e string")
    assert got == ["buy", "aria", "imagem", "alt", "two words", "div", "z" * 120]


def test_coercion(column):
    texts = ["7", " 7 ", "7.5", "", "true", "false", "abc", None, "NaN", "Infinity", "1e400", "-0"]
    numbers = column(v.to_number, [(t,) for t in texts], "t string")
    assert numbers == [7, 7, 7.5, 0, 1, 0, None, None, None, None, None, 0]
    whole = column(v.to_whole, [(t,) for t in texts], "t string")
    assert whole == [7, 7, None, 0, 1, 0, None, None, None, None, None, 0]
    flags = column(v.to_flag, [(t,) for t in texts], "t string")
    assert flags[:8] == [True, True, True, False, True, False, True, False]


def test_clamps(column):
    values = [(-1.0,), (0.5,), (2.0,), (None,), (float("nan"),), (float("inf"),)]
    assert column(v.clamp01, values, "x double") == [0, 0.5, 1, None, None, None]
    assert column(lambda x: v.peak(x, "max_q"), [(-3,), (7,), (99,), (None,)], "x int") == [0, 7, 10, 0]
    assert column(v.score, [(12,), (None,)], "x int") == [10, None]
    assert column(v.band, [(0,), (1,), (4,), (5,), (None,)], "x int") == [None, 1, 4, None, None]


def test_rounding(column):
    # exact ties go up: 0.25 -> 0.3, 12.5 % -> 12.5, 1/16 -> 6.3 %
    assert column(v.mean1, [(1, 4), (5, 2), (0, 0), (7, 3)], "s long, n long") == [0.3, 2.5, 0.0, 2.3]
    assert column(v.pct1, [(1, 8), (1, 16), (2, 3), (0, 0)], "a long, b long") == [12.5, 6.3, 66.7, 0.0]


def test_shares_of_counts_that_fill_an_int(column):
    most = 2**31 - 1
    cases = [(1_073_742, 2_147_483), (most, most), (1, most), (0, 0), (None, 5)]
    assert column(v.pct1, cases, "a int, b int") == [50.0, 100.0, 0.0, 0.0, None]
    assert column(v.round_ratio, [(5, 2), (7, 3), (0, 0)], "a long, b long") == [3, 2, 0]


def test_grid_cell_uses_the_stored_float(column):
    # 0.35 stored as a 4-byte number is a little less than 0.35
    cell = lambda x: v.grid_cell(x.cast("float"), 60)
    assert column(cell, [(0.35,), (1.0,), (0.0,)], "x double") == [20, 59, 0]


def test_list_arguments():
    assert list_args("events") == (150, 0)
    assert list_args("events", "9999", "-4") == (300, 0)
    assert list_args("sessions", 0, "12abc") == (60, 12)
    assert list_args("orders", "abc", None) == (100, 0)
    assert list_args("orders", -5) == (10, 0)
    assert grid_args("5", 1000) == (20, 400)
    assert click_args("phone", "7", "") == (None, None, None)
    assert click_args("tablet", "3", "x" * 50) == ("tablet", 3, "x" * 40)


def test_period_filter(spark):
    moments = [dt.datetime(2024, 1, d, h) for d, h in [(4, 23), (5, 0), (25, 23), (26, 0), (31, 0)]]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
    keep = lambda *a, **k: sorted(r.ts for r in period_filter(df, "ts", *a, **k).collect())
    assert keep("2024-01-05", "2024-01-25") == moments[1:3]
    assert keep("2024-01-05") == moments[1:]
    as_of = "2024-02-04 00:00:00"
    assert keep(None, "2024-01-25", as_of=as_of) == moments[2:]       # a lone end is ignored
    assert keep("5/1/2024", as_of=as_of) == moments[2:]
    with pytest.raises(ValueError):
        period_filter(df, "ts", "2024-13-45")


def test_period_filter_prunes_days(spark, tmp_path):
    df = spark.range(10).select(
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id").cast("int"))).alias("ts")
    ).withColumn("dt", F.to_date("ts"))
    df.write.partitionBy("dt").parquet(str(tmp_path / "log"))
    kept = period_filter(spark.read.parquet(str(tmp_path / "log")), "ts", "2024-01-03", "2024-01-04")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert kept.count() == 2
