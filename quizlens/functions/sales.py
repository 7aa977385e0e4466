"""Normalising what a sale notification says: money, status, method, ids."""

from pyspark.sql import functions as F

from quizlens.fixed_values import (
    MAX_RAW_CHARS, METHOD_PATTERNS, NO_ID_PREFIX, RAW_SUMMARY_CHARS, SESSION_IN_TEXT,
    STATUS_PATTERNS, WIDTH,
)


def _first_match(text, patterns):
    """Name of the first pattern, in list order, found in ``text``."""
    return F.coalesce(
        *[F.when(text.rlike(f"(?i){pattern}"), F.lit(name)) for pattern, name in patterns]
    )


def status(text):
    return _first_match(text, STATUS_PATTERNS)


def method(text):
    short = F.lower(F.substring(text, 1, WIDTH["metodo"]))
    return F.when(text != "", F.coalesce(_first_match(text, METHOD_PATTERNS), short))


def amount_cents(field, text):
    """Cents from an amount whose unit is not declared.

    A field name with ``cent`` is taken at its word. Otherwise fractions and
    whole numbers below 1000 are in units, larger whole numbers are in cents.
    With both separators present the comma is the decimal one.
    """
    bare = F.regexp_replace(text, r"[^0-9.,\-]", "")
    both = bare.contains(",") & bare.contains(".")
    undotted = F.when(both, F.regexp_replace(bare, r"\.", "")).otherwise(bare)
    # only the first comma becomes the decimal point; a second one spoils the number
    number = F.regexp_replace(undotted, r"^([^,]*),", "$1.").try_cast("double")
    in_units = (number != F.floor(number)) | (number < 1000)
    already_cents = F.coalesce(field.contains("cent"), F.lit(False))
    cents = F.when(~already_cents & in_units, number * 100).otherwise(number)
    return F.floor(cents + F.lit(0.5)).try_cast("int")


def session_in_text(text):
    """The first thing in a text that looks like a session id, else NULL."""
    return F.nullif(F.regexp_extract(text, SESSION_IN_TEXT, 0), F.lit(""))


def fallback_order_id(payload):
    """A key for a notification without any id: the same text gives the same key."""
    return F.concat(F.lit(NO_ID_PREFIX), F.substring(F.sha1(payload), 1, 24))


def is_too_long(payload):
    return F.length(payload) > MAX_RAW_CHARS


def cap_raw(payload):
    """The payload as stored: very long ones are replaced by a short summary."""
    summary = F.struct(
        F.lit(True).alias("_truncado"),
        F.length(payload).alias("tamanho"),
        F.substring(payload, 1, RAW_SUMMARY_CHARS).alias("inicio"),
    )
    return F.when(is_too_long(payload), F.to_json(summary)).otherwise(payload)


def normalize_key(name):
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
