"""I-Match fingerprints over randomised lexicons.

Document frequencies of all terms are counted over the whole corpus. The lexicon
is the band of terms that are neither too common nor too rare (by the share of
documents that hold them). ``LEVELS * PER_LEVEL`` random subsets of the lexicon
are drawn; on each level a subset holds half as much as on the one before. A
text's fingerprint lists, for every subset, a hash of its sorted distinct terms
in that subset (``-`` if it has none). Two fingerprints are compared level by
level: of the subsets that are not empty in both, the share with equal hashes;
the best level counts, because short texts need large subsets and long texts
small ones.

A term is in at least the share ``LOW`` of documents, so the lexicon can hold no
more than (mean distinct terms per document) / LOW terms at any corpus size.

A null text is empty; texts without lexicon terms have the fingerprint of hashes
of nothing and a suffix of the text's own hash, so that only equal ones match.
The next document is the one with the next smaller ``doc_id``; after the last
comes the first. Rows of one ``doc_id`` follow each other ordered by text. Rows
with a null ``doc_id`` come last.
"""

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import BROADCAST_ROWS, by_batch, cut_lineage, in_process, sliced

LOW, HIGH = 0.001, 0.1      # band of the share of documents
LEVELS, PER_LEVEL = 9, 12
FLUSH = 400_000
LETTER_EDGES = ".,;:!?\"'()[]{}<>|*#$%&"


def terms(text):
    """Lower-case words without punctuation at their ends."""
    return {w.strip(LETTER_EDGES) for w in set(text.lower().split())} - {""}


def _counted(documents: DataFrame, only=None, share=None) -> DataFrame:
    """``term, df`` by chunks of documents, one row per chunk and term.

    ``only``: a broadcast set of the terms to count. ``share``: give out a term of a chunk only if at
    least this share of the chunk's documents hold it.
    """
    from pyspark.sql.types import StructType

    target = StructType.fromDDL("term string, df long")

    def run(batches):
        found, seen = Counter(), 0
        wanted = only.value if only is not None else None

        def flushed():
            least = 0 if share is None else share * seen
            some = [(term, n) for term, n in found.items() if n >= least]
            return pa.RecordBatch.from_pydict({"term": [t for t, _ in some], "df": [n for _, n in some]})

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                own = terms(text or "")
                found.update(own if wanted is None else own & wanted)
                seen += 1
                if len(found) >= FLUSH:
                    yield flushed()
                    found, seen = Counter(), 0
        if found:
            yield flushed()

    return documents.select("text").mapInArrow(run, target)


def document_frequencies(documents: DataFrame) -> DataFrame:
    """``term, df`` over all documents. Tasks count first, so only sums are shuffled."""
    return _counted(documents).groupBy("term").agg(F.sum("df").alias("df"))


def frequent_terms(documents: DataFrame, share: float) -> DataFrame:
    """``term, df`` over all documents, of the terms that at least this share of them hold.

    Such a term has at least that share in some chunk of the documents, however they are cut.
    A first pass finds these terms, a second one counts them, so rare terms are not shuffled. If
    too many come up to send them to all tasks, all terms are counted instead.
    """
    able = cut_lineage(_counted(documents, share=share).select("term").distinct())
    if able.count() > BROADCAST_ROWS:
        return document_frequencies(documents)
    wanted = documents.sparkSession.sparkContext.broadcast({row[0] for row in able.collect()})
    return _counted(documents, only=wanted).groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(documents: DataFrame, low=LOW, high=HIGH):
    """Sorted terms in the band; their number has the bound named above."""
    n = documents.count()
    counted = frequent_terms(documents, low)
    band = counted.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    return sorted(row[0] for row in band.select("term").collect())


def _draw(words):
    """Level 0..: for each term a row of flags, one per subset; from a hash of the term, so repeatable."""
    import xxhash

    n = LEVELS * PER_LEVEL
    shares = np.repeat(0.5 ** (1 + np.arange(LEVELS)), PER_LEVEL)
    seeds = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    flags = np.zeros((len(words), n), bool)
    for at in range(0, len(words), 10_000):
        x = keys[at:at + 10_000, None] ^ seeds
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        flags[at:at + 10_000] = (x ^ (x >> np.uint64(31))) / 2.0**64 < shares
    return keys, flags


class Printer:
    def __init__(self, words):
        self.place = {w: i for i, w in enumerate(words)}
        self.keys, self.flags = _draw(words)

    def marks(self, text):
        """One hash per subset; 0 for an empty one."""
        import xxhash

        found = terms(text)
        known = np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))
        known = np.sort(known[known >= 0])      # lexicon order is sorted
        if not len(known):
            return np.zeros(LEVELS * PER_LEVEL, np.uint32)
        # subset after subset; one-dimensional, which numpy looks through faster
        subsets, chosen = np.divmod(np.flatnonzero(self.flags[known].T.ravel()).astype(np.int32), np.int32(len(known)))
        ends = np.cumsum(np.bincount(subsets, minlength=LEVELS * PER_LEVEL) * 8).tolist()
        raw, digest = self.keys[known[chosen]].tobytes(), xxhash.xxh3_64_intdigest
        return np.array([
            (digest(raw[start:end]) & 0xFFFFFFFF) or 1 if end > start else 0 for start, end in zip([0, *ends], ends)
        ], np.uint32)

    def fingerprint(self, text, marks):
        import xxhash

        if marks.any():
            return ",".join(["-" if m == 0 else f"{m:x}" for m in marks.tolist()])
        return "-" + xxhash.xxh3_128_hexdigest(text)


def likeness(a, b):
    """Of two arrays of marks: the best level's share of equal subsets among those not empty in both."""
    used = ((a > 0) | (b > 0)).reshape(LEVELS, PER_LEVEL).sum(1)
    same = ((a == b) & (a > 0)).reshape(LEVELS, PER_LEVEL).sum(1)
    enough = used >= max(1, min(4, int(used.max(initial=0))))
    return float((same[enough] / used[enough]).max(initial=0.0)) if enough.any() and used.any() else 0.0


def _below(cuts, value):
    """How many of the sorted ``cuts`` are smaller, looked up in two steps of a square root each."""
    width = max(1, int(len(cuts) ** 0.5))
    whole, ahead = (F.array(*map(F.lit, c)).cast("array<bigint>") for c in (cuts, cuts[::width]))
    smaller = lambda some: F.size(F.filter(some, lambda c: c < value))
    first = F.greatest(smaller(ahead) - 1, F.lit(0)) * width
    return first + smaller(F.slice(whole, first + 1, F.lit(width)))


def with_next(documents: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each row beside the next one by falling ``doc_id``.

    Rows are cut into ranges of ids; each range also gets the first row of the range after it,
    so that a window inside the range knows every neighbour. The number of ranges grows with the
    table, and only the first ids of ranges, one each, are joined by broadcast.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = rows.sparkSession
    known = rows.where("doc_id is not null")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * 4)
    cuts = known.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    # range 0 holds the largest ids; null ids form the last range
    last = len(cuts) + 1
    place = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(len(cuts)) - _below(cuts, F.col("doc_id"))).cast("int")
    placed = rows.withColumn("part", place)
    # the first row of each range: the largest id and, among its rows, the smallest text
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("part")     # one row per range
    after = heads.withColumn("before", F.lag("part").over(order))
    first = heads.agg(F.min("part").alias("low"), F.max("part").alias("high")).first()
    if first["low"] is None:
        return placed.select("doc_id", "text", F.col("text").alias("next_text"))
    after = after.withColumn("before", F.coalesce("before", F.lit(first["high"])))
    tops = F.broadcast(after.select(F.col("part").alias("of"), "top", "before"))
    head_rows = (
        placed.join(tops, (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("of", "before").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("part"), F.lit(1).alias("halo"))
    )
    both = placed.withColumn("halo", F.lit(0)).unionByName(head_rows)
    follow = Window.partitionBy("part").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    return (
        both.withColumn("next_text", F.lead("text").over(follow)).where("halo = 0").select("doc_id", "text", "next_text")
    )


def edited(text, after):
    """The last third replaced by as much from the start of the next text."""
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def fingerprints(documents: DataFrame, words) -> DataFrame:
    """``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next``."""
    shared = documents.sparkSession.sparkContext.broadcast((words, hash(tuple(words))))

    def work():
        printer = in_process("imatch", shared.value[1], lambda: Printer(shared.value[0]))
        last = [None, None, None]

        def marks(text):
            """Marks and fingerprint; the next row's text is that of the row after, so it is looked at once."""
            if last[0] != text:
                own = printer.marks(text)
                last[:] = text, own, printer.fingerprint(text, own)
            return last[1:]

        def step(rows):
            out = {n: [] for n in ("n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for text, after in zip(rows["text"], rows["next_text"]):
                own, a = marks(text)
                changed = edited(text, after)
                new = printer.marks(changed)
                b = printer.fingerprint(changed, new)
                following, c = marks(after)    # the next row's own
                values = (
                    len(text), changed, a, b, 1.0 if a == b else likeness(own, new),
                    1.0 if a == c else likeness(own, following),
                )
                for name, value in zip(out, values):
                    out[name].append(value)
            return {"doc_id": rows["doc_id"], **out}

        return step

    return by_batch(
        with_next(documents), work,
        "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
