"""Mixing sources to target weights by systematic sampling.

Sources, in the order of their names (null last), take the weights of a repeating list and share
all words of the corpus by weight. A target stops at ``MOST`` times its source's size; what is over
goes to the others by weight until none is above.

All documents of a source have the same expected copies, target / source size. One half of them,
by a bit of a digest, is put in order of size, the other half follows from long to short; expected
copies are summed up along that order, one random offset of the source is added, and a document is
given out once for each whole number that its stretch of the sum passes. Neighbours are of like
length, and what the offset gains on the way up it loses on the way down, so the words taken differ
from the target by less than the longest document. The sum, the offset and the rate are whole
numbers over one denominator, so nothing is rounded and reruns agree.

Rows that are equal in every column are counted before they are shuffled and take one stretch
together, so the rows in order are distinct and any source, size or id can be spread over many
tasks. Only narrow rows (id, source, size, digest) are put in order.

A null or empty text has no words; it is given out at its source's rate and takes 0 words. A null
``source`` is a source of its own. Documents of a source without any word are not given out. Rows
with a null or a repeated ``doc_id`` count one by one. An empty table gives an empty mix.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import WORD, cut_lineage, expand, few_enough, running_total

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
LONGEST = 2**40     # more words than a text can have
EXACT = "decimal(38,0)"


def _digest(documents: DataFrame):
    """A digest of all columns of a row."""
    texts = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in documents.columns)
    return F.md5(F.concat_ws("\x1f", *texts).cast("binary"))


def _items(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, _h, _n``: one row for each distinct row of ``documents``, counted."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = documents.select("doc_id", "source", size, _digest(documents).alias("_h"))
    return rows.groupBy("doc_id", "source", "size", "_h").agg(F.count("*").alias("_n"))


def _random(name, below):
    """A whole number from 0 up to ``below``, from a digest of the source's name."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit("="), name), F.lit(""))).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast(EXACT)
    return F.when(below > 0, F.pmod(drawn, below))


def targets(sizes: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """``source, source_size, target`` and the exact rate ``_num / _den`` for rows of ``source, source_size``.

    A share is ``weight * rest / open``: ``rest`` words are left for sources of ``open`` weight in all
    that are not at their limit. Limits make the share of the others grow, so a source once at its limit
    stays there, and each round is one sum over the sources.
    """
    sizes = sizes.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(sizes, [], [F.col("source").asc_nulls_last()], "_one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_before") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("source", "source_size", weight.cast("long").alias("_w")))
    size, w = F.col("source_size").cast("decimal(16,0)"), F.col("_w").cast("decimal(10,0)")

    def limited(rest, open_):
        return size * F.lit(most) * F.lit(open_).cast("decimal(12,0)") < w * F.lit(rest).cast("decimal(16,0)")

    whole = ranked.agg(F.sum(size), F.sum(w)).first()
    state, last = (int(whole[0] or 0), int(whole[1] or 0)), None
    while state != last:
        last = state
        at_limit = limited(*state)
        row = ranked.agg(F.sum(F.when(at_limit, size)), F.sum(F.when(~at_limit, w))).first()
        state = int(whole[0] or 0) - most * int(row[0] or 0), int(row[1] or 0)
    rest, open_ = state
    at_limit = limited(rest, open_)
    num = F.when(at_limit, F.lit(most)).otherwise(w * F.lit(rest).cast("decimal(16,0)")).cast(EXACT)
    den = F.when(at_limit, F.lit(1)).otherwise(size * F.lit(max(open_, 1)).cast("decimal(12,0)")).cast(EXACT)
    target = F.when(at_limit, (size * F.lit(most)).cast("double")).otherwise(
        num.cast("double") / F.lit(float(max(open_, 1)))
    )
    return ranked.select(
        "source", "source_size", target.alias("target"), num.alias("_num"), den.alias("_den"),
        _random(F.col("source"), den).alias("_offset"),
    )


def _passed(position):
    """Whole numbers passed before ``position`` documents of the source."""
    exact = position.cast("decimal(20,0)") * F.col("_num").cast("decimal(17,0)") + F.col("_offset")
    return F.call_function("div", exact.cast(EXACT), F.col("_den"))


def shares(documents: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """One row for each distinct row of ``documents`` (``_n`` of them) with its stretch of the running sum."""
    items = cut_lineage(_items(documents))
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    aimed = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    named = items.withColumn("_name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    up = F.col("_h") < "8"
    named = named.withColumn("_turn", F.when(up, F.col("size")).otherwise(LONGEST - F.col("size")))
    placed = running_total(named, ["_name"], ["_turn", "_h"], "_n").drop("_name", "_turn")
    return placed.join(few_enough(cut_lineage(aimed)), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _copies(first, number):
    crossed = _passed(first + number) - _passed(first)
    return F.when(F.col("source_size") > 0, crossed).otherwise(0).cast("long")


def draw(documents: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row."""
    rows = expand(shares(documents, weights, most), "_n", ["_h"])
    rows = rows.withColumn("copies", _copies(F.col("_before") + F.col("_k"), F.lit(1)))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(documents: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it; same columns, in no order.

    Of rows that are equal in every column, one is given out as often as all of them together.
    """
    given = shares(documents, weights, most).select(
        "_h", "_n", _copies(F.col("_before"), F.col("_n")).alias("_copies")
    ).where("_copies > 0")
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    rows = documents.select(row, _digest(documents).alias("_h")).join(given, "_h")
    once = rows.where("_n = 1").unionByName(rows.where("_n > 1").dropDuplicates(["_h"]))
    return expand(once, "_copies", ["_h"]).select("_row.*")
