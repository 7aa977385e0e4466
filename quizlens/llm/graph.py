"""Connected components on edges of a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` (the smallest id that can be reached) for every end of the edges ``a, b``.

    Rounds of two steps, each a grouping and a join: every node links its larger neighbours, and
    then its smaller ones, to the smallest node it sees. It ends in stars, after a number of rounds
    that grows with the logarithm of the longest path.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        ).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = cut_lineage(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
