"""From a sale notification of unknown shape to order fields.

Every JSON value becomes a *leaf* (name, path, text). Fields are then picked by
name and priority with array functions on the row, so extraction adds no
shuffle and no row multiplication. Documents of any depth and number of values are read whole.
"""

import json
import math
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.fixed_values import (
    FIELD_NAMES, FORBIDDEN_CONTEXT, GENERIC_ID_NAMES, ORDER_CONTEXT, ORDER_ID_NAMES, ROOT_ID_NAMES, SESSION_FIELD_NAMES, UNKNOWN_STATUS, WIDTH,
)
from quizlens.functions import sales
from quizlens.functions.values import cut_or_null

LEAVES = T.ArrayType(T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("key", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("is_text", T.BooleanType()),
]))
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
_NOT_NAME = re.compile("[^a-z0-9]")


def _reject(_):
    raise ValueError("not JSON")


def _in_page_order(item):
    """Members of an object in the order a browser lists them: array-like names
    first, by number, then the rest as written."""
    if not item or min(item) >= ":":        # no name starts with a digit
        return item.items()
    numbered = {n for n in item if _INDEX.fullmatch(n) and int(n) < 2**32 - 1}
    rest = [n for n in item if n not in numbered]
    return [(n, item[n]) for n in sorted(numbered, key=int) + rest]


def _as_text(value):
    """A JSON number or flag as text, numbers in their shortest form."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    size = abs(value)
    if 1e-6 <= size < 1e21:
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, _, power = repr(value).partition("e")
    return f"{mantissa.removesuffix('.0')}e{power[0]}{power[1:].lstrip('0')}"


def _normal(name):
    return _NOT_NAME.sub("", name.lower())


def _storable(text):
    """Text that UTF-8 can hold: half of a surrogate pair alone becomes the replacement mark."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _nested(text, scalar):
    """The JSON value of a text of any depth, with an own stack in place of recursion.

    Used for what is nested too deeply for the standard decoder; ``scalar`` reads anything else
    than objects and arrays.
    """
    blank = re.compile(r"[ \t\n\r]*")
    root, at = [], blank.match(text).end()
    stack, name = [root], None

    def expect(sign, at):
        if text[at:at + 1] != sign:
            raise ValueError("not JSON")
        return blank.match(text, at + 1).end()

    def named(at):
        if text[at:at + 1] != '"':
            raise ValueError("not JSON")
        key, end = scalar(text, at)
        return key, expect(":", blank.match(text, end).end())

    while True:
        opened = text[at:at + 1]
        value, end = ({}, at + 1) if opened == "{" else ([], at + 1) if opened == "[" else scalar(text, at)
        holder = stack[-1]
        holder.append(value) if isinstance(holder, list) else holder.__setitem__(name, value)
        at = blank.match(text, end).end()
        if opened in ("{", "["):
            stack.append(value)
            if text[at:at + 1] not in ("}", "]"):
                if opened == "{":
                    name, at = named(at)
                continue
        while len(stack) > 1 and text[at:at + 1] == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop()
            at = blank.match(text, at + 1).end()
        if len(stack) == 1:
            if at < len(text):
                raise ValueError("not JSON")
            return root[0]
        at = expect(",", at)
        if isinstance(stack[-1], dict):
            name, at = named(at)


def _leaves(text, decoder, keys):
    """``(ord, key, path, value, is_text)`` of every value in document order; ``keys`` remembers names."""
    try:
        try:
            root = decoder.decode(text)
        except RecursionError:
            root = _nested(text, decoder.scan_once)
    except (ValueError, TypeError, StopIteration):
        return []
    if not isinstance(root, (dict, list)):
        return []
    found, waiting = [], [(root, "", "")]
    while waiting:
        value, name, above = waiting.pop()
        if isinstance(value, list):
            waiting.extend((item, name, above) for item in reversed(value))
            continue
        if value is None:
            continue
        if name not in keys:
            keys[name] = _normal(name)
        own = ".".join(part for part in (above, keys[name]) if part)
        if isinstance(value, dict):
            waiting.extend((item, member, own) for member, item in reversed(list(_in_page_order(value))))
        else:
            is_text = isinstance(value, str)
            found.append((len(found), keys[name], own, _storable(value) if is_text else _as_text(value), is_text))
    return found


@F.arrow_udf(LEAVES)
def leaves_of(payloads: pa.Array) -> pa.Array:
    decoder = json.JSONDecoder(parse_int=float, parse_constant=_reject)
    ends, rows, keys = [0], [], {}
    for text in payloads.to_pylist():
        rows += _leaves(text, decoder, keys)
        ends.append(len(rows))
    columns = zip(*rows) if rows else ((), (), (), (), ())
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
    flat = pa.StructArray.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, kinds)],
        names=["ord", "key", "path", "value", "is_text"],
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def with_leaves(notifications):
    return notifications.withColumn("leaves", leaves_of("payload"))


def payload_leaves(notifications):
    """One row per leaf: ``seq, ord, key, path, value, is_text``."""
    # an outer one, so that Spark does not call the function once more for the size of its array
    return with_leaves(notifications).select("seq", F.inline_outer("leaves")).filter(F.col("ord").isNotNull())


def _filled(leaf):
    return leaf["value"] != ""


def _by_priority(names):
    """The non-empty leaf with the best-ranked name; the first in the document on a tie."""
    ranking = F.array(*[F.lit(n) for n in names])
    named = F.filter("leaves", lambda leaf: leaf["key"].isin(names) & _filled(leaf))
    ranked = F.transform(named, lambda leaf: F.struct(
        F.array_position(ranking, leaf["key"]).alias("rank"), leaf["ord"].alias("ord"),
        leaf["key"].alias("key"), leaf["value"].alias("value"), leaf["is_text"].alias("is_text"),
    ))
    return F.array_min(ranked)


def _truthy(leaf):
    return leaf["is_text"] | ~leaf["value"].isin("0", "false")


def _parent_path(leaf):
    return F.substring(leaf["path"], F.lit(1), F.length(leaf["path"]) - F.length(leaf["key"]))


def _inside_order():
    """The best generic id whose parent is an order and not a product, buyer or event."""
    def fits(leaf):
        parent = _parent_path(leaf)
        return (
            leaf["key"].isin(GENERIC_ID_NAMES) & _filled(leaf)
            & parent.rlike(ORDER_CONTEXT) & ~parent.rlike(FORBIDDEN_CONTEXT)
        )

    ranking = F.array(*[F.lit(n) for n in GENERIC_ID_NAMES])
    return F.array_min(F.transform(F.filter("leaves", fits), lambda leaf: F.struct(
        F.array_position(ranking, leaf["key"]).alias("rank"), leaf["ord"].alias("ord"),
        leaf["value"].alias("value"),
    )))


def _at_root():
    return F.get(F.filter("leaves", lambda leaf: (
        leaf["key"].isin(ROOT_ID_NAMES) & (leaf["path"] == leaf["key"]) & _filled(leaf)
    )), F.lit(0))


def _session_in_texts():
    texts = F.filter("leaves", lambda leaf: leaf["is_text"])
    matches = F.transform(texts, lambda leaf: sales.session_in_text(leaf["value"]))
    return F.get(F.array_compact(matches), F.lit(0))


def with_ids(found):
    """Add ``order_id`` and ``session_id`` to rows with ``payload`` and ``leaves``.

    The order's id is an unmistakable name, else a generic name inside an order
    object, else an id at the root, else a digest of the notification. The visit
    is in the first filled link field, else in any text that holds something
    shaped like a session id. An id too long to be stored is not cut, which could merge
    two orders: the digest stands for it.
    """
    picked = found.select(
        "*", _by_priority(ORDER_ID_NAMES).alias("_clear"), _inside_order().alias("_inside"),
        _at_root().alias("_root"), _by_priority(SESSION_FIELD_NAMES).alias("_link"),
    )
    clear, link = F.col("_clear"), F.col("_link")
    order = F.coalesce(
        F.when(_truthy(clear), clear["value"]), F.col("_inside.value"), F.col("_root.value")
    )
    linked = F.when(_truthy(link), sales.session_in_text(link["value"]))
    return picked.select(
        *found.columns,
        F.coalesce(
            F.when(F.length(order).between(1, WIDTH["order_id"]), order), sales.fallback_order_id(F.col("payload"))
        ).alias("order_id"),
        F.coalesce(linked, _session_in_texts()).alias("session_id"),
    )


def first_by_name(notifications):
    """The picked leaf of every known field: ``seq, field, key, value``."""
    picks = F.array(*[
        F.struct(F.lit(field).alias("field"), _by_priority(names).alias("leaf"))
        for field, names in FIELD_NAMES.items()
    ])
    return (
        with_leaves(notifications)
        .select("seq", F.inline(picks))
        .filter(F.col("leaf").isNotNull())
        .select("seq", "field", F.col("leaf.key").alias("key"), F.col("leaf.value").alias("value"))
    )


def extract(notifications):
    """Raw notifications (``seq, received_ts, payload``) as normalised order messages."""
    found = with_ids(with_leaves(notifications)).select(
        "seq", "received_ts", "payload", "order_id", "session_id",
        *[_by_priority(names).alias(f"f_{field}") for field, names in FIELD_NAMES.items()],
    )
    picked = lambda field: F.when(F.col(f"f_{field}").isNotNull(), F.col(f"f_{field}.value"))
    meant = lambda field: F.when(_truthy(F.col(f"f_{field}")), picked(field))
    stored = lambda field, column: cut_or_null(picked(field), WIDTH[column]).alias(column)
    return found.select(
        "seq", "received_ts", "order_id", "session_id",
        F.coalesce(
            sales.status(meant("status")), sales.status(meant("evento")), F.lit(UNKNOWN_STATUS)
        ).alias("status"),
        stored("evento", "evento"),
        sales.amount_cents(F.col("f_valor.key"), picked("valor")).alias("valor_cents"),
        sales.method(meant("metodo")).alias("metodo"),
        stored("produto", "produto"),
        stored("nome", "cliente_nome"),
        stored("email", "cliente_email"),
        stored("fone", "cliente_fone"),
        stored("utm_source", "utm_source"),
        stored("utm_campaign", "utm_campaign"),
        F.col("payload").alias("raw"),
    )
