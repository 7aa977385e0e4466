import hashlib
import json

import pytest

from quizlens.operators import payload


def notes(spark, bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "seq long, payload string")
    return df.selectExpr("seq", "timestamp '2024-01-01' AS received_ts", "payload")


def extracted(spark, *bodies):
    return payload.extract(notes(spark, bodies)).orderBy("seq").collect()


def test_order_id_passes(spark):
    got = extracted(
        spark,
        {"eventType": {"code": "ORDER_PAID"}, "order": {"id": "A1"}},
        {"product": {"id": "P"}, "id": "R"},
        {"order": {"items": [{"id": "i1"}]}, "hash": "H"},
        {"sale": {"code": "C"}, "transaction-ID": "T"},
        {"order_id": 0, "payment": {"uuid": "U"}},
        {"order_id": "", "saleId": "S"},
        {"order": {"id": 0}},
        {"orderId": 12345678901234567890},
        {"orderId": "x" * 200},
    )
    # an id that is too long to be stored is not cut: the digest stands for it
    assert [r.order_id for r in got] == [
        "A1", "R", "H", "T", "U", "S", "0", "12345678901234567000",
        "sem-id-" + hashlib.sha1(got[-1].raw.encode()).hexdigest()[:24],
    ]


def test_no_id_falls_back_to_a_digest_of_the_text(spark):
    first, again, other = extracted(spark, '{"a":1}', '{"a":1}', '{"a":2}')
    assert first.order_id == again.order_id != other.order_id
    assert first.order_id.startswith("sem-id-") and len(first.order_id) == 31


def test_session_links(spark):
    sid, other = "btabcdefghijklm9", "btzzzzzzzzzzzzzz"
    got = extracted(
        spark,
        {"note": f"x?sck={sid}&y=1"},
        {"src": sid, "btSid": other},
        {"sck": "nothing here", "free": sid},
        {"src": "", "tracking": f"go {sid}"},
        {"x": [None, {"y": "no"}]},
    )
    assert [r.session_id for r in got] == [sid, other, sid, sid, None]


def test_fields_and_normalisation(spark):
    (row,) = extracted(spark, {
        "event": "purchase", "status": False, "amount": "1", "totalValue": 14.9, "paymentMethod": "Pix",
        "customer": {"name": "Ana", "email": "a@b.c", "phone": 5511}, "product": {"name": ""},
        "utm_source": "ig", "campaign": None, "title": "Curso",
    })
    assert (row.status, row.evento, row.valor_cents, row.metodo) == ("desconhecido", "purchase", 1490, "pix")
    assert (row.cliente_nome, row.cliente_email, row.cliente_fone) == ("Ana", "a@b.c", "5511")
    assert (row.produto, row.utm_source, row.utm_campaign) == ("Curso", "ig", None)


@pytest.mark.parametrize("body", ["", "not json", "[1", '"text"', "12", "null", '{"a":NaN}'])
def test_unreadable_bodies_have_no_leaves(spark, body):
    assert payload.payload_leaves(notes(spark, [body])).count() == 0


def leaves(spark, body):
    rows = payload.payload_leaves(notes(spark, [body])).orderBy("ord").collect()
    return [(r.key, r.path, r.value, r.is_text) for r in rows]


def test_leaf_paths(spark):
    assert leaves(spark, {"A-b": [{"C d": 1}, [True, None]], "9": "x", "2": "y", "e": {"": "z"}}) == [
        ("2", "2", "y", True), ("9", "9", "x", True), ("cd", "ab.cd", "1", False),
        ("ab", "ab", "true", False), ("", "e", "z", True),
    ]


def test_numbers_are_written_shortest(spark):
    body = '{"a":1490.0,"b":1e21,"c":1e-7,"d":0.000001,"e":-0.0,"f":123456789012345680000,"g":1e400}'
    assert [v for _, _, v, _ in leaves(spark, body)] == [
        "1490", "1e+21", "1e-7", "0.000001", "0", "123456789012345680000", "Infinity"
    ]


def test_any_depth_and_number_of_values(spark):
    deep = {"v": 1}
    for _ in range(50):
        deep = {"k": deep}
    assert leaves(spark, deep) == [("v", ".".join(["k"] * 50) + ".v", "1", False)]
    assert len(leaves(spark, {f"k{i}": i for i in range(700)})) == 700
    late = {f"k{i}": i for i in range(700)} | {"order_id": "A1", "status": "paid"}
    nested = {"order_id": "B2", "status": "paid"}
    for _ in range(10):
        nested = {"data": nested}
    got = extracted(spark, late, nested)
    assert [r.order_id for r in got] == ["A1", "B2"] and got[0].status == got[1].status == "pago"


def test_depths_beyond_the_decoder_s_stack(spark):
    n = 200_000
    body = "[" * n + '{"a":[1,{"b":"x\\"]"},[]],"order_id":"C3"}' + "]" * n
    assert leaves(spark, body) == [("a", "a", "1", False), ("b", "a.b", 'x"]', True), ("orderid", "orderid", "C3", True)]
    assert leaves(spark, "[" * n + "1" + "]" * (n - 1)) == [] == leaves(spark, "[" * n + "1,]" + "]" * n)


def test_half_a_surrogate_pair_is_replaced(spark):
    assert leaves(spark, '{"a":"x\\ud800y","b":"\\ud83d\\ude00"}') == [("a", "a", "x\ufffdy", True), ("b", "b", "\U0001f600", True)]
