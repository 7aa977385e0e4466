import datetime as dt
import random

from quizlens.operators import folds, ingest
from quizlens.sources import sample

T0 = dt.datetime(2024, 1, 1)
NOTE = ("seq long, received_ts timestamp_ntz, order_id string, session_id string, status string, "
        "evento string, valor_cents int, metodo string, produto string, cliente_nome string, "
        "cliente_email string, cliente_fone string, utm_source string, utm_campaign string, raw string")


def note(seq, status, order="o", session=None, cents=None, evento=None):
    return (seq, T0 + dt.timedelta(minutes=seq), order, session, status, evento, cents,
            None, None, None, None, None, None, None, f"raw{seq}")


def at(seq):
    return T0 + dt.timedelta(minutes=seq)


def one(df):
    (row,) = df.collect()
    return row


def test_order_follows_the_last_status_and_keeps_the_first_payment(spark):
    rows = [note(1, "pendente", evento="a"), note(2, "pago", session="s1", cents=1490),
            note(3, "pago", session="s2"), note(4, "pendente")]
    notes = spark.createDataFrame(rows + rows[2:], NOTE)      # redelivered notifications change nothing
    order = one(folds.with_raw(folds.order_fold(notes), notes))
    assert (order.status, order.session_id, order.valor_cents, order.evento) == ("pendente", "s1", 1490, "a")
    assert (order.created_at, order.updated_at, order.paid_at) == (at(1), at(4), at(2))
    assert order.raw == "raw4" and order.moeda == "BRL"


def test_refund_clears_the_purchase_but_keeps_its_value(spark):
    rows = [note(1, "pago", session="s", cents=100), note(2, "pago", session="s"),
            note(3, "estornado", order="p", session="s", cents=7), note(4, "pendente", session="s")]
    bought = one(folds.purchase_fold(spark.createDataFrame(rows, NOTE)))
    assert (bought.purchased, bought.purchase_cents, bought.purchase_ts) == (False, 100, at(1))


def batch(seq, device=None, vw=None, **session):
    shape = {f.name: None for f in ingest.schemas.SNAPSHOT_IN.fields} | {"vw": vw} | session
    return (seq, T0, None, "session-1", device, [], [], tuple(shape.values()))


def batches(spark, rows):
    from quizlens import schemas

    kind = schemas.BATCH.simpleString()[len("struct<"):-1]
    return spark.createDataFrame(rows, f"batch_seq long, received_ts timestamp_ntz, country string, {kind}")


def test_first_batch_fixes_the_origin_even_when_empty(spark):
    rows = [batch(1, utm_source=None, maxQ=9, score=3, duration=5, lastSection="a"),
            batch(2, device="mobile", vw=400, utm_source="ig", maxQ=4, contact=True, lastSection=None),
            batch(3, device="watch", maxQ=99, score=None, band=7)]
    visit = one(folds.session_fold(batches(spark, rows)))
    assert (visit.device, visit.vw, visit.utm_source) == (None, None, None)
    assert (visit.max_q, visit.score, visit.band, visit.contact) == (10, 3, None, True)
    assert (visit.last_section, visit.duration_sec) == ("a", 5)


def test_order_of_rows_and_replays_do_not_matter(spark, data):
    rows = sample.tables(spark, data).notifications.collect()
    schema = sample.tables(spark, data).notifications.schema
    expected = sorted(map(tuple, folds.order_fold(spark.createDataFrame(rows, schema)).collect()), key=repr)
    mixed = rows + rows[:300]
    random.Random(7).shuffle(mixed)
    shuffled = spark.createDataFrame(mixed, schema).repartition(7)
    assert sorted(map(tuple, folds.order_fold(shuffled).collect()), key=repr) == expected
