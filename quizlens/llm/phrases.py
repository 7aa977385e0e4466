"""Phrase collocations from FM-indexes of shards.

A shard is the texts of one language that a task has read, up to ``SHARD_WORDS`` words, as a sequence of
word ids with 0 between pieces. Two depth-limited Burrows-Wheeler transforms, of the sequence and of the
sequence read backwards, form a bidirectional index: suffixes are sorted by their first ids only, as many
as the phrases have, which is all that their intervals need. Phrases are enumerated by extending the
intervals of all phrases of one length at once, to the right and to the left in turn; an interval's width
is the count. Only counts leave a shard and are summed on Spark.

Lengths are counted one after the other. What occurs less than the asked number of times in all shards
has no frequent extension, so after each length a bitmap of ``SLOTS`` bits is sent out in which the hashes of
the frequent phrases are set; a shard's next index leaves out words, and its enumeration phrases, whose bit is
not set. A rare phrase that shares a bit is only counted in vain: results don't depend on the bitmap, and its
size does not depend on the data. Scores, containment and ranks are joins and groups over the summed phrases.

Texts are lower-cased in A-Z only and cut into pieces at ``[.,;:!?]`` and line ends, pieces into words at
spaces and tabs. A phrase lies inside a piece. Null and empty texts have no words; a null language counts as
``und``. Long texts are taken up in slabs that end between pieces, so nothing is cut. Repeated rows count
each. Phrases of equal score and count are ranked by their bytes. An empty table has no phrases.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import Numbering, cut_lineage, few_enough, sliced

SHARD_WORDS = 1_000_000
SLOTS, BUCKET = 2**26, 2**15
MULTIPLIER = 1_000_003
PARTS = 16          # in which a language's phrases are ranked first
SLAB_BYTES = 2**20
CUT = b"\xff"       # a byte that UTF-8 never uses
SCALE = 1_000_000


def _byte_table():
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    for sign in b".,;:!?\n\v\f\r":
        table[sign] = CUT[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


def slabs(text: bytes, table: bytes):
    """Lists of the words of ``text``, with ``CUT`` after each piece; a list is about ``SLAB_BYTES`` long."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(CUT, at + SLAB_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(CUT, b" \xff ").split()
        at = end


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of whole numbers."""
    bits = len(keys).bit_length()
    if int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)[1]
    placed = np.sort(keys << bits | np.arange(len(keys)))
    values = placed >> bits
    placed &= (1 << bits) - 1
    out = np.empty(len(keys), np.int64)
    out[placed] = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    return out


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The ids before each suffix, suffixes sorted by their first ``depth`` ids. The sequence is a ring."""
    rank, width = ids.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        rank, width = ranks(rank * (int(rank.max()) + 1) + np.roll(rank, -step)), width + step
    bits = len(ids).bit_length()
    order = np.sort(rank << bits | np.arange(len(ids))) & (1 << bits) - 1
    return ids[order - 1]


class Occurrences:
    """Where each id stands in a transform: answers how often an id occurs before a place."""

    def __init__(self, last, first):
        self.size = len(last)
        order = np.argsort(last, kind="stable")
        self.keys, self.first = last[order].astype(np.int64) * self.size + order, first

    def before(self, ids, places):
        return np.searchsorted(self.keys, ids.astype(np.int64) * self.size + places) - self.first[ids]


def ngrams(ids: np.ndarray, longest: int, wanted=lambda phrases: None):
    """Yields ``phrases, counts`` for each length up to ``longest``; ``phrases`` has a row of ids each.

    ``wanted`` gives a mask of the phrases to go on with, or None for all.
    ``low`` holds where the phrases' intervals start in the transform of the sequence (0) and of the sequence
    read backwards (1). In the first the ids of an interval precede its phrase, in the second they follow it.
    """
    last = transform(ids, longest), transform(ids[::-1], longest)
    counts = np.bincount(ids)
    first = np.concatenate(([0], np.cumsum(counts)))
    known = np.flatnonzero(counts)
    known = known[known > 0]
    phrases, width, low = known[:, None], counts[known], (first[known], first[known])
    occurs = {}
    for length in range(1, longest + 1):
        yield phrases, width
        if length == longest or not len(phrases):
            return
        side = length % 2       # 1: extend to the right, by what the backwards transform holds
        places = np.arange(width.sum()) + np.repeat(low[side] - (np.cumsum(width) - width), width)
        key = np.repeat(np.arange(len(width)) * len(first), width)
        key += last[side][places]
        del places
        found, more = np.unique(key, return_counts=True)
        del key
        owner, sign = found // len(first), found % len(first)
        # inside the other index the extensions follow each other by id
        passed = np.cumsum(more) - more
        at_owner = np.searchsorted(owner, np.arange(len(width)))
        other = low[1 - side][owner] + passed - passed[at_owner][owner]
        whole = sign > 0
        owner, sign, width, other = owner[whole], sign[whole], more[whole], other[whole]
        if length + 1 < longest:
            if side not in occurs:
                occurs[side] = Occurrences(last[side], first)
            own = first[sign] + occurs[side].before(sign, low[side][owner])
        else:
            own = other         # not looked at again
        low = (other, own) if side else (own, other)
        new = sign[:, None]
        phrases = np.hstack((phrases[owner], new) if side else (new, phrases[owner]))
        mask = wanted(phrases)
        if mask is not None:
            phrases, width, low = phrases[mask], width[mask], (low[0][mask], low[1][mask])


def slots(lang, phrase):
    """A phrase's place in the bitmap of its length, as a column."""
    start = F.pmod(F.crc32(lang.cast("binary")), F.lit(SLOTS))
    return F.aggregate(
        F.split(phrase, " "), start, lambda h, word: F.pmod(h * MULTIPLIER + F.crc32(word.cast("binary")), F.lit(SLOTS))
    )


def bitmap(phrases: DataFrame) -> bytearray:
    """``SLOTS`` bits, of which those of ``phrases`` (``lang, phrase``) are set."""
    slot = phrases.select(slots(F.col("lang"), F.col("phrase")).alias("slot"))
    buckets = slot.groupBy(F.expr(f"slot div {BUCKET}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bits")
    )
    out = bytearray(SLOTS // 8)
    for row in buckets.collect():       # at most SLOTS / BUCKET rows of BUCKET / 8 bytes
        at = row["bucket"] * BUCKET // 8
        out[at:at + BUCKET // 8] = row["bits"]
    return out


def _tester(lang, names, bitmaps):
    """The mask of a shard's phrases whose parts of each counted length may be frequent."""
    signs = np.array([zlib.crc32(name) for name in names], np.int64)
    start = zlib.crc32(lang.encode()) % SLOTS
    bitmaps = [np.frombuffer(bits, np.uint8) for bits in bitmaps]

    def test(phrases):
        mask = np.ones(len(phrases), bool)
        size = phrases.shape[1]
        for length, bits in enumerate(bitmaps, 1):
            if length < size - 1:
                continue        # tested with the phrase that was extended
            for first in range(size - length + 1):
                slot = np.full(len(phrases), start)
                for k in range(first, first + length):
                    slot = (slot * MULTIPLIER + signs[phrases[:, k]]) % SLOTS
                mask &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        return mask

    return test


def counted(documents: DataFrame, length: int, bitmaps=()) -> DataFrame:
    """``lang, phrase, f`` of phrases of ``length`` words by shard, whose shorter parts are set in ``bitmaps``.

    With single words comes a row of an empty phrase, which has the number of all words.
    """
    from pyspark.sql.types import StructType

    target = StructType.fromDDL("lang string, phrase string, f long")
    context = documents.sparkSession.sparkContext
    sent = [context.broadcast(bytes(bits)) for bits in bitmaps]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, table = to_arrow_schema(target), _byte_table()
        shards, held = {}, 0

        def rows_of(lang, names, parts):
            ids = np.concatenate(parts)
            parts.clear()
            names = list(names)
            if length == 1:
                yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": [""], "f": [int((ids > 0).sum())]}, schema)
            test = _tester(lang, names, [bits.value for bits in sent])
            if sent:
                known = test(np.arange(len(names))[:, None])
                known[0] = False
                ids = np.where(known[ids], ids, 0)
                ids = ids[(ids > 0) | (np.roll(ids, 1) > 0)]
                if not len(ids):
                    return
            vocabulary = pa.array(["" if name == CUT else name.decode() for name in names])
            for phrases, counts in ngrams(ids, length, test):
                for at in range(0, len(counts) if phrases.shape[1] == length else 0, 100_000):
                    some = phrases[at:at + 100_000]
                    words = [vocabulary.take(pa.array(some[:, k])) for k in range(length)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some)), pc.binary_join_element_wise(*words, " "),
                        pa.array(counts[at:at + 100_000].astype(np.int64)),
                    ], schema=schema)

        def flushed():
            for lang in list(shards):
                yield from rows_of(lang, *shards.pop(lang))

        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                for words in slabs(text.as_py() or b"", table):
                    if not words:
                        continue
                    if lang not in shards:
                        shards[lang] = Numbering(), []
                        shards[lang][0][CUT] = 0
                    names, parts = shards[lang]
                    words.append(CUT)
                    parts.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
                    held += len(words)
                    if held >= SHARD_WORDS:
                        yield from flushed()
                        held = 0
        yield from flushed()

    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, target)


def frequent(documents: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, words, phrase, f`` of every phrase of up to ``longest`` words that occurs ``least`` times.

    Rows of 0 words have the number of all words of a language.
    """
    levels, bitmaps = [], []
    for length in range(1, longest + 1):
        sums = counted(documents, length, bitmaps).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        level = cut_lineage(sums.where((F.col("f") >= least) | (F.col("phrase") == "")))
        if length < longest:
            bitmaps.append(bitmap(level))
        levels.append(level.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(length)))
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)
    return known


def score(a, l, r):  # noqa: E741
    """``floor(SCALE * a * a / (l * r))`` of exact numbers of up to 15 digits."""
    return F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), l * r)


def collocations(documents: DataFrame, longest=3, least=10, share=50) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of every phrase of 2 to ``longest`` words that stays.

    A candidate occurs ``least`` times or more (``a``). Cut in two, its parts occur ``l`` and ``r`` times, and
    the cut of the lowest score ``floor(SCALE * a * a / (l * r))`` counts, the earliest of several. A candidate
    inside a longer one that has ``share`` percent of its occurrences goes. ``n`` is all words of the language.
    """
    known = frequent(documents, longest, least)     # every part of a candidate is as frequent as it
    candidates = known.where("words >= 2")

    size = F.col("words")
    parts = F.split("phrase", " ")
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " ")),
    ))
    covered = (
        candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    staying = candidates.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))
    )

    cuts = staying.select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), parts.alias("_p")
    ).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice("_p", F.lit(1), F.col("k")), " ").alias("_first"),
        F.array_join(F.slice("_p", F.col("k") + 1, size - F.col("k")), " ").alias("_rest"),
    )
    for part, name in (("_first", "l"), ("_rest", "r")):
        length = F.col("k") if name == "l" else size - F.col("k")
        cuts = cuts.withColumn("_words", length)
        found = known.where(f"words between 1 and {longest - 1}").select(
            "lang", F.col("words").alias("_words"), F.col("phrase").alias(part), F.col("f").alias(name)
        )
        # the counts of single words are looked up most; there are few of them
        single = cuts.where("_words = 1").join(few_enough(found.where("_words = 1")), ["lang", "_words", part])
        cuts = single.unionByName(cuts.where("_words > 1").join(found.where("_words > 1"), ["lang", "_words", part]))
        cuts = cuts.drop("_words", part)
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    scored = cuts.withColumn("score", score(a, l, r))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    total = known.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(few_enough(total), "lang").select(
        "lang", "phrase", "words", "a", "_best.l", "_best.r", "n", "_best.score"
    )


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language, with their ``rank`` from 1."""
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]

    def first(rows, *groups):
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*by))
        return rows.withColumn("rank", place).where(F.col("rank") <= most)

    # the first of each of a fixed number of parts, so that what meets for a language does not grow with the input
    parts = first(found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "_salt")
    return first(parts.drop("_salt"), "lang").withColumn("rank", F.col("rank").cast("long"))
