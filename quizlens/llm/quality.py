"""Quality rules: a table of thresholds compiled into one projection.

Words are maximal runs of characters other than space and ``\\t``-``\\r``. Every
measure is a built-in expression over the whole text and every rule compares a
measure, or the ratio of two, with a bound, so the judgement is one map stage
without a shuffle and without user functions.

A null or empty text has no words and fails ``few_words``. Repeated rows are
judged alike; other columns of the input are neither read nor kept.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import WORD

# fixed values: symbols that the contract counts, and frequent function words of the four languages
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by at this are from or an have not "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch "
    "le la les de et des en un une du que est pour dans qui sur pas au par avec "
    "el los las y del se con una para por su al lo como más o pero sus le"
).split()

# fixed values: the threshold table. name, numerator, denominator (None: 1), relation, bound
RULES = (
    ("few_words", "n_words", None, "<", 50),
    ("repeated_words", "n_repeat_words", "n_words", ">", 0.5),
    ("short_words", "word_chars", "n_words", "<", 2.5),
    ("long_words", "word_chars", "n_words", ">", 12),
    ("symbols", "n_symbols", "n_words", ">", 0.1),
    ("capitals", "n_capital_words", "n_words", ">", 0.5),
    ("no_stop_words", "n_stop_words", "n_words", "<", 0.02),
    ("repeated_lines", "n_dup_lines", "n_lines", ">", 0.4),
    ("bullet_lines", "n_bullet_lines", "n_lines", ">", 0.9),
    ("cut_lines", "n_cut_lines", "n_lines", ">", 0.3),
)


def let(value, body):
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated(words):
    """Positions covered by 3-word windows that occur at least twice, the first occurrence included."""
    def windows(hashes):
        each = F.transform(
            F.sequence(F.lit(1), F.size(hashes) - 2),
            lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1)),
        )
        return let(each, counted)

    def counted(marks):
        again = let(F.sort_array(marks), lambda a: F.array_distinct(F.filter(a, lambda h, i: h == F.get(a, i - 1))))
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), 0).otherwise(
            let(again, lambda twice: placed(marks, twice))
        )

    def placed(marks, twice):
        """Both branches give the same; the first one is quicker for a few repeated windows."""
        numbered = F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        few = F.filter(numbered, lambda w: F.array_contains(twice, w["h"]))
        return F.when(F.size(twice) <= 40, let(F.transform(few, lambda w: w["i"]), spread)).otherwise(
            let(F.sort_array(numbered), covered)
        )

    def covered(ordered):
        double = F.filter(
            ordered,
            lambda w, k: (F.get(ordered, k - 1)["h"] == w["h"]) | (F.get(ordered, k + 1)["h"] == w["h"]),
        )
        return let(F.sort_array(F.transform(double, lambda w: w["i"])), spread)

    def spread(starts):
        steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    enough = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) >= 3, enough).otherwise(0)


def measured(rows: DataFrame, text: str, keep) -> DataFrame:
    """The columns ``keep`` of ``rows`` with the measures of the column ``text``.

    A measure that is zero for most texts is counted only behind a cheap test.
    """
    words, lines, text_ = F.col("_words"), F.col("_lines"), F.col("_text")
    some = lambda test, count: F.when(test, count).otherwise(0).cast("long")
    bare = lambda word: F.lower(F.rtrim(word, F.lit(".,;:!?")))
    shouted = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
    spaced = text_
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": some(text_.rlike(f"[{SYMBOLS}]"), F.length(text_) - F.length(F.translate(text_, SYMBOLS, ""))),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_capital_words": some(
            text_.rlike(r"[A-Z\u00C0-\u00DE]{2}"), F.size(F.filter(words, lambda w: w.rlike(shouted) & (F.length(w) > 1)))
        ),
        "n_stop_words": F.size(F.filter(words, lambda w: bare(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        "n_bullet_lines": F.size(
            F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "|"))
        ).cast("long"),
        "n_cut_lines": some(
            text_.contains("...") | text_.contains("…"), F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
        ),
    }
    return (
        rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .select(
            *keep, "_text",
            F.filter(F.split(spaced, " "), lambda word: word != "").alias("_words"),
            F.filter(F.split(text_, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        )
        .select(*keep, *(value.alias(name) for name, value in counts.items()))
    )


def failing(rules=RULES):
    """The names of the rules that a row of measures fails, as one array expression."""
    def fails(numerator, denominator, relation, bound):
        left, right = F.col(numerator).cast("double"), F.lit(float(bound))
        if denominator:
            right = right * F.col(denominator)
        return left < right if relation == "<" else left > right

    return F.filter(
        F.array(*(F.when(fails(*rule), name) for name, *rule in rules)), lambda name: name.isNotNull()
    )


def _judged(df, rules):
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("failed", failing(rules)).withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def judge(documents: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id``, the measures, ``failed`` (names of failed rules), ``base_failed`` and ``kept``.

    ``base_failed`` holds for under 50 words or over half of them in repeated windows.
    """
    return _judged(measured(documents.select("doc_id", "text"), "text", ["doc_id"]), rules)


def keep(documents: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``documents`` that pass every rule, with their columns as they are."""
    names = documents.columns
    taken = [f"c{i}" for i in range(len(names))]
    wide = documents.toDF(*taken)
    judged = _judged(measured(wide, taken[names.index("text")], taken), rules)
    # a filter on measures alone would be moved below them, and each measure be derived once for every use
    counted = judged.withColumn("_nth", F.monotonically_increasing_id())
    return counted.where("kept and _nth >= 0").select(*(F.col(a).alias(n) for a, n in zip(taken, names)))
