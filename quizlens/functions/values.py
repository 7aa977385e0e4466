"""Coercion, clamping and exact rounding of single values."""

from pyspark.sql import functions as F

from quizlens.fixed_values import BANDS, PEAK


def cut(column, width):
    """Text cut to a stored width; NULL stays NULL and '' stays ''."""
    return F.substring(column, 1, width)


def cut_or_null(column, width):
    """As ``cut``, but an empty text counts as missing."""
    return F.nullif(F.substring(column, 1, width), F.lit(""))


def blank_to(column, default):
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
HEXADECIMAL = r"^\s*0[xX][0-9a-fA-F]{1,13}\s*$"       # up to the whole numbers a double holds exactly


def _number(text):
    """Text as a number by the tracker's own grammar, which knows no type suffixes but hexadecimals."""
    word = F.when(text.isin("true"), 1.0).when(F.trim(text).isin("", "false"), 0.0)
    sixteen = F.conv(F.substring(F.trim(text), 3, 13), 16, 10).try_cast("double")
    return F.when(text.rlike(DECIMAL), F.trim(text).try_cast("double")).when(text.rlike(HEXADECIMAL), sixteen).otherwise(word)


def to_number(text):
    """A finite number or NULL, from text: blank reads as 0, true/false as 1/0."""
    return finite(_number(text))


def finite(number):
    """NULL for not-a-number, which Spark orders above everything, and for infinities."""
    largest = float(1.7976931348623157e308)
    return F.when(F.abs(number) <= largest, number)


def to_whole(text):
    """A whole number that fits an int, or NULL; fractions are refused."""
    number = _number(text)
    return F.when(number.try_cast("int") == number, number.try_cast("int"))


def to_flag(text):
    """Truthiness of a flag received as text: false for nothing, blank and zero."""
    return F.coalesce(_number(text) != 0, text.isNotNull())


def truthy(value):
    """Truthiness of a flag as it was sent, a VARIANT: of a text, that it is not empty (``"0"`` and ``"false"`` are
    true); of a number, that it is not zero; an object or a list is true; null and nothing are false."""
    kind, taken = F.schema_of_variant(value), lambda type_: F.try_variant_get(value, "$", type_)
    return F.coalesce(
        F.when(kind == "STRING", taken("string") != "")
        .when(kind == "BOOLEAN", taken("boolean"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), taken("double") != 0)
        .otherwise(kind != "VOID"),
        F.lit(False),
    )


def or_zero(text, number):
    """``number``, read from ``text``, with 0 for text that is no number at all; NULL for no text."""
    return F.when(text.isNotNull() & to_number(text).isNull(), F.lit(0)).otherwise(number)


def clamp(column, low, high):
    """``column`` limited to [low, high]; NULL stays NULL."""
    return F.when(column.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), column)))


def clamp01(column):
    return clamp(finite(column.cast("double")), 0.0, 1.0)


def peak(column, name):
    """A peak column of a session: missing counts as 0."""
    return clamp(F.coalesce(column, F.lit(0)), 0, PEAK[name]).cast("int")


def score(column):
    return clamp(column, 0, PEAK["score"]).cast("int")


def band(column):
    return F.when(column.isin(BANDS), column).cast("int")


def device(column, names):
    return F.when(column.isin(names), column)


def flag(column):
    return F.coalesce(column, F.lit(False))


def day_key(ts):
    return F.date_format(ts, "yyyy-MM-dd")


def micros(ts):
    """Microseconds since 1970 of a timestamp, with or without time zone (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def mean1(total, count):
    """total/count rounded half up to one decimal, 0 when there is nothing to average."""
    exact = (F.lit(20) * total + count).cast("double") / (F.lit(2) * count).cast("double")
    return F.when(count > 0, F.floor(exact) / F.lit(10.0)).otherwise(F.lit(0.0))


def pct1(part, whole):
    """100*part/whole rounded half up to one decimal, 0 when whole is 0. Counts are widened first: 2000 of them pass an int."""
    part, whole = part.cast("long"), whole.cast("long")
    exact = (F.lit(2000) * part + whole).cast("double") / (F.lit(2) * whole).cast("double")
    return F.when(whole > 0, F.floor(exact) / F.lit(10.0)).otherwise(F.lit(0.0))


def round_ratio(total, count):
    """total/count rounded half up to a whole number, 0 when count is 0."""
    return F.when(
        count > 0, F.floor(total.cast("double") / count.cast("double") + F.lit(0.5))
    ).otherwise(F.lit(0)).cast("long")


def cents_to_unit(cents):
    return cents / F.lit(100.0)


def grid_cell(share, cells):
    """Cell number of a 0..1 position on an axis of ``cells`` cells."""
    return F.least(F.lit(cells - 1), F.floor(share.cast("double") * F.lit(cells))).cast("int")


def question_number(section):
    """The digits of a question name as a number, NULL when it has none."""
    return F.nullif(F.regexp_replace(section, r"\D", ""), F.lit("")).try_cast("int")


def count_where(condition):
    return F.count_if(condition).cast("int")


def rows():
    return F.count(F.lit(1)).cast("int")


def distinct(column):
    return F.count_distinct(column).cast("int")


def sum_where(value, condition):
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")
