"""Sharding by extendible hashing.

A document's place is a hash of its key. The directory starts with one bucket;
a bucket over the byte limit splits on the next bit of the hash, and only such
a bucket does. A shard is named by its prefix of bits (``""`` if nothing split).

Sizes are counted for all prefixes of ``STEP`` bits at once, one shuffle of
sums; buckets still too large after those go on with the next bits.

Rows whose whole hash is the same can't be told apart by bits. If such rows are
over the limit together, each row of them is numbered and the running number's
blocks become shards of their own (suffix ``.k``), so that they fit too. A
single text over the limit is a shard by itself. A null text has 0 bytes; a
null key is hashed as the empty text.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import cut_lineage, few_enough

BITS, STEP = 60, 12


def _hash(key):
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth):
    """The first ``depth`` bits (a column or a number) of ``_h`` as a number."""
    return F.call_function("shiftright", F.col("_h"), (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``depth, prefix, bytes`` of every leaf for rows of ``_h`` and ``_bytes``."""
    leaves, open_ = [], sizes.select("_h", "_bytes")
    known = None
    for first in range(0, BITS, STEP):
        last = min(first + STEP, BITS)
        bins = open_.groupBy(_prefix(F.lit(last)).alias("bin")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n"))
        levels = (
            bins.select("bytes", "n", "bin", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"))
            .withColumn("prefix", F.call_function("shiftright", F.col("bin"), (F.lit(last) - F.col("depth")).cast("int")))
            .groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        )
        levels = cut_lineage(levels.withColumn("over", (F.col("bytes") > limit) & (F.col("n") > 1)))
        above = levels.where("over").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        child = levels.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        split = child.join(above, ["depth", "up"], "left_semi").drop("up")
        # what is looked at here is over the limit at depth `first`, except the root in the first round
        start = levels.where(f"depth = {first}") if known is None else levels.limit(0)
        nodes = split.unionByName(start)
        leaves.append(nodes.where(f"not over or depth = {BITS}"))
        more = nodes.where(f"over and depth = {last}").select(F.col("prefix").alias("bin"))
        if last == BITS or more.isEmpty():
            break
        known = more
        open_ = open_.withColumn("bin", _prefix(F.lit(last))).join(more, "bin", "left_semi").drop("bin")
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out.select("depth", "prefix", "bytes", "over")


def assign(documents: DataFrame, limit: int, key="doc_id", whole=False) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes`` for each row; ``whole`` adds the row itself as ``_row``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes")
    row = [F.struct(*(documents[c] for c in documents.columns)).alias("_row")] if whole else []
    carried = ["_row"] if whole else []
    rows = documents.select("doc_id", size, _hash(F.col(key)).alias("_h"), *row)
    leaves = cut_lineage(directory(rows, limit))
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most BITS + 1 numbers
    leaves = few_enough(leaves)
    depths = depths or [0]
    keys = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.lit(d)).alias("prefix")) for d in depths))
    placed = (
        rows.select("*", F.explode(keys).alias("_k")).select("doc_id", "_bytes", "_h", "_k.*", *carried)
        .join(leaves, ["depth", "prefix"])
    )
    bits = F.when(F.col("depth") == 0, "").otherwise(
        F.expr("lpad(conv(prefix, 10, 2), depth, '0')")
    )
    placed = placed.withColumn("shard", bits)
    apart = placed.where(~F.col("over")).select("doc_id", "_bytes", "shard", "depth", "bytes", *carried)
    out = apart
    if not leaves.where("over").isEmpty():
        out = apart.unionByName(_by_number(placed.where("over"), limit))
    return out.select(
        "doc_id", F.col("_bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"),
        F.col("bytes").alias("shard_bytes"), *carried,
    )


def _by_number(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one whole hash: blocks of a running sum of bytes, cut so that each stays in the limit.

    Rows are first dealt to salted parts and summed there, so no task holds a whole key.
    """
    rows = cut_lineage(rows.withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("shard", "_part").orderBy("doc_id", "_bytes")
    # a block takes half the limit of running sum, and one row may reach over its end by at most its own size
    summed = rows.withColumn("_sum", F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bytes"))
    alone = F.col("_bytes") * 2 > limit
    number = F.when(alone, F.concat_ws("-", F.col("_part"), F.lit("x"), F.row_number().over(order))).otherwise(
        F.concat_ws("-", F.col("_part"), F.floor(F.col("_sum") / F.lit(limit / 2)).cast("long"))
    )
    named = summed.withColumn("_one", number)
    sizes = named.groupBy("shard", "_one").agg(F.sum("_bytes").alias("_size"))
    return named.join(sizes, ["shard", "_one"]).select(
        "doc_id", "_bytes", F.concat_ws(".", "shard", "_one").alias("shard"), "depth", F.col("_size").alias("bytes"),
        *(c for c in rows.columns if c == "_row"),
    )


def write(documents: DataFrame, path: str, limit: int, key="doc_id"):
    """Write the rows as one folder of files per shard below ``path``.

    The folders are named ``shard=...``, with marks in front as long as the rows have such a column.
    """
    name = "shard"
    while name in documents.columns:
        name = "_" + name
    placed = assign(documents, limit, key, whole=True).select("_row.*", F.col("shard").alias(name))
    placed.repartition(name).write.partitionBy(name).parquet(path)
