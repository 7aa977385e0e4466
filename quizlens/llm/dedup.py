"""Near duplicates by MinHash with tensored banding.

A document's set holds its distinct 5-word shingles (a shorter text is one
shingle). Two small collections of ``m`` hash values each, every one made of
``WIDTH`` minima, give ``m * m`` table keys by pairing: 4 * m minima stand for
m * m * 4. Equal sets are one class first. Classes that meet in a table are
joined to the smallest class of the bucket, which gives groups; inside a group
all full sets are compared, in blocks of bounded size, and only pairs that reach
the similarity count as links. Connected components of the links follow.

With m = 12, a pair of similarity 0.75 shares no table with probability 1e-4,
one of 0.8 with 2e-5, and being in one group by way of others lowers that.

A null or empty text, or one without words, has an empty set and no links. Rows
that share a ``doc_id`` are one document, whose links are pooled. A row with a
null ``doc_id`` is judged by nothing: its component is null and it is kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import by_batch, cut_lineage, few_enough, in_process, sliced, tidied
from quizlens.llm.graph import components

SHINGLE, M, WIDTH = 5, 12, 2
PERCENT = 75
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
KEEP = 100_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words; frequent words are hashed once."""

    def __missing__(self, word):
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def shingles(self, text):
        """Sorted distinct 64-bit hashes of the shingles of a text."""
        words = text.encode("utf-8", "replace").translate(FOLD).split()
        if len(self) > 2 * KEEP:
            for word in list(self)[KEEP:]:
                del self[word]
        values = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if not len(values):
            return values
        if len(values) < SHINGLE:
            # the whole sequence; its length keeps it apart from real shingles
            total = _mix((values * MIX[:len(values)]).sum(keepdims=True) + np.uint64(len(values)))
        else:
            n = len(values) - SHINGLE + 1
            total = sum(values[i:i + n] * MIX[i] for i in range(SHINGLE))
            total = _mix(total)
        return np.unique(total)


# ASCII capitals to small letters; bytes.split() then cuts at space and \t-\r only
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def _minima(values):
    """The two collections: 2 * M hash values of WIDTH minima each."""
    rng = np.random.default_rng(20240229)
    n = 2 * M * WIDTH
    factor = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, n, np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        h = values[at:at + 4096, None] * factor + shift
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(0))
    low = low.reshape(2 * M, WIDTH)
    return _mix(low[:, 0] * MIX[2] + low[:, 1] * MIX[3])


def sketch(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, left, right``: 128 bits of the set and the two collections."""
    def work():
        hashes = in_process("dedup_words", "words", WordHashes)

        def step(rows):
            import xxhash

            out = {n: [] for n in ("n_shingles", "set_a", "set_b", "left", "right")}
            for text in rows["text"]:
                values = hashes.shingles(text or "")
                digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), "<i8")
                both = _minima(values).view(np.int64) if len(values) else np.zeros(2 * M, np.int64)
                for name, value in zip(out, (len(values), digest[0], digest[1], both[:M], both[M:])):
                    out[name].append(value)
            return {"doc_id": rows["doc_id"], **out}

        return step

    return by_batch(
        documents.select("doc_id", "text"), work,
        "doc_id long, n_shingles long, set_a long, set_b long, left array<long>, right array<long>",
    )


def candidate_edges(classes: DataFrame) -> DataFrame:
    """``a, b``: each class with the smallest class of every bucket it is in."""
    keys = (
        classes.select("id", F.posexplode("left").alias("i", "l"), "right")
        .select("id", "i", "l", F.posexplode("right").alias("j", "r"))
        .select("id", F.xxhash64("i", "j", "l", "r").alias("key"))
    )
    # sums before the shuffle; a bucket of two needs no second look
    buckets = cut_lineage(
        keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where("n > 1")
    )
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    more = keys.join(buckets.where("n > 2").select("key", "low"), "key").select(F.col("low").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(more).where("a < b").distinct()


def similar(sets, left, right):
    """Pairs (i, j), i in ``left``, j in ``right``, whose sets reach the similarity, as a spanning forest."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    values = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    right_sizes, same = sizes[right], left is right
    found = []
    for p, i in enumerate(left):
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        spans = high - low
        total = int(spans.sum())
        if not total:
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(right))
        hit = 100 * shared >= PERCENT * (sizes[i] + right_sizes - shared)
        if same:
            hit[:p + 1] = False
        for q in np.flatnonzero(hit):
            a, b = root(i), root(right[q])
            if a != b:
                parent[a] = b
                found.append((i, right[q]))
    return found


def links(documents: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b``: links found inside groups, enough of them to connect what is linked.

    ``members`` has ``id`` (a ``doc_id``, one per class) and ``grp``.
    """
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(few_enough(members), "id")

    def sets():
        hashes = in_process("dedup_words", "words", WordHashes)

        def step(rows):
            values = [hashes.shingles(text or "") for text in rows["text"]]
            return {
                "id": rows["id"], "grp": rows["grp"], "n": [len(v) for v in values], "shingles": [v.tobytes() for v in values],
            }

        return step

    full = by_batch(texts, sets, "id long, grp long, n long, shingles binary")
    sizes = members.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("total"))
    blocks = sizes.select(
        "grp",
        F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = full.join(blocks, "grp").withColumn("block", block)
    dealt = placed.select(
        "id", "grp", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "id", "grp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "shingles"
    )
    dealt = dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "block", "id")
    return dealt.mapInArrow(tidied(_compare), "a long, b long")


def _compare(batches):
    """Streams rows sorted by block pair; holds one block pair at a time."""
    def solved(key, rows):
        _, x, y = key
        ids = [r[0] for r in rows]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        left = [i for i, r in enumerate(rows) if r[1] == x]
        right = left if x == y else [i for i, r in enumerate(rows) if r[1] == y]
        return [(ids[i], ids[j]) for i, j in similar(sets, left, right)] if left and right else []

    def batch_of(pairs):
        return pa.RecordBatch.from_pydict(
            {"a": [int(p[0]) for p in pairs], "b": [int(p[1]) for p in pairs]},
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]),
        )

    current, rows, out = None, [], []
    for batch in sliced(batches):
        columns = batch.to_pydict()
        for row in zip(columns["grp"], columns["x"], columns["y"], columns["id"], columns["block"], columns["shingles"]):
            if row[:3] != current:
                if rows:
                    out += solved(current, rows)
                current, rows = row[:3], []
            rows.append(row[3:])
        if out:
            yield batch_of(out)
            out = []
    if rows:
        out += solved(current, rows)
    yield batch_of(out)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    documents = documents.select("doc_id", "text")
    sketches = cut_lineage(sketch(documents))
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    smallest = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"))
    # rows of one set are alike in all but their id
    classes = cut_lineage(
        usable.join(smallest, ["set_a", "set_b"], "inner").where("doc_id = id")
        .dropDuplicates(["set_a", "set_b", "id"])
        .select("set_a", "set_b", "id", "n_shingles", "left", "right")
        # small rows that become M * M each: spread before they are multiplied
        .repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "id")
    )
    edges = cut_lineage(candidate_edges(classes))
    groups = components(edges)
    sizes = classes.groupBy("id").agg(F.sum("n_shingles").alias("n_shingles"))
    members = cut_lineage(groups.select("id", F.col("label").alias("grp")).join(sizes, "id"))
    found = cut_lineage(links(documents.where("doc_id is not null"), members))
    # rows that share an id pool their links, also when their sets differ
    shared = usable.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    pooled = (
        usable.join(shared, "doc_id", "left_semi").join(smallest, ["set_a", "set_b"])
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    )
    linked = components(found.unionByName(pooled))
    label = linked.select("id", "label")
    named = smallest.join(label, "id", "left").select(
        "set_a", "set_b", F.coalesce("label", "id").alias("component")
    )
    rows = sketches.select("doc_id", "n_shingles", "set_a", "set_b")
    whole = rows.where("doc_id is not null and n_shingles > 0").join(named, ["set_a", "set_b"])
    rest = rows.where("doc_id is null or n_shingles = 0").withColumn("component", F.col("doc_id"))
    return whole.unionByName(rest, allowMissingColumns=True).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all columns.

    Rows that repeat a ``doc_id`` are told apart by their texts: equal ones are one, different ones are
    compared like other documents, so none is lost but to a row that is like it. Rows with a null
    ``doc_id``, and without words, all stay. Of repeated rows any one stays.
    """
    counts = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"))
    twice = cut_lineage(counts.where("_n > 1").select("doc_id"))
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    rows = documents.select(row, "doc_id", "text")
    if twice.isEmpty():
        rows = rows.withColumn("_own", F.lit(False))
    else:
        # below zero, where no id is that was given out
        text_id = -F.abs(F.xxhash64("doc_id", "text") % F.lit(2**62)) - 1
        rows = rows.join(few_enough(twice.withColumn("_twice", F.lit(True))), "doc_id", "left")
        rows = rows.withColumn("_own", F.coalesce("_twice", F.lit(False))).drop("_twice")
        rows = rows.withColumn("doc_id", F.when(F.col("_own"), text_id).otherwise(F.col("doc_id")))
    judged = near_duplicates(rows.select("doc_id", "text"))
    gone = few_enough(cut_lineage(judged.where("not kept").select("doc_id").distinct()))
    kept = rows.join(gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return kept.select("_row.*")
    once = kept.where("_own").dropDuplicates(["doc_id"])
    return kept.where("not _own").unionByName(once).select("_row.*")
