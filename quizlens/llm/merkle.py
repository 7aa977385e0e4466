"""Merkle manifest of a table, with a proof for every row.

H is the lowercase hex sha256 of its inputs put together. A leaf is H of a row's columns, each ``-``
if null, else its length in UTF-8 bytes, ``:`` and the value. The leaves of a group ascend by the
order column; every ``ARITY`` consecutive nodes (a last run may be shorter, even one) become their H
until one node is left, the group's subroot. The subroots, ordered by group (null first), make the
root in the same way.

The leaves' places come from sums over ranges of the order, so a group may hold any share of the
rows. ``BLOCK`` consecutive leaves are a superblock; it is reduced to one node, and these nodes are
again leaves of the next tier, until one is left. On the way back each tier's nodes are cogrouped by
superblock with the one outer row that holds all digests needed above the superblock; one pass over
the two finishes the local reduction, joins the local with the outer part of each proof and folds
every leaf up to the root. A task holds one superblock of digests, never texts.

Null columns are hashed as ``-``; a null group is a group of its own, and null values of the order
come first. Rows with equal order values go by their leaves; equal leaves of a group are counted
before they are shuffled and get neighbouring places. Empty and very long texts are values like any
other. An empty table has no leaves, no root and no rows.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import cut_lineage, expand, few_enough, running_total

ARITY = 8
DEPTH = 4
BLOCK = ARITY**DEPTH

OUTER = "subroot string, root string, path array<string>"


def leaf(columns: list):
    """The leaf of a row as a column; ``columns`` are Column expressions."""
    def field(value):
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def _digest(texts):
    from hashlib import sha256

    return sha256("".join(texts).encode()).hexdigest()


def _levels(digests, total):
    """The levels of one superblock, its leaves first, its node last; ``total`` nodes are on the tier's first level."""
    levels = [digests]
    while len(levels) <= DEPTH and total > 1:
        below = levels[-1]
        levels.append([_digest(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
        total = -(-total // ARITY)
    return levels


def _node(rows: pd.DataFrame) -> pd.DataFrame:
    """A superblock's node."""
    rows = rows.sort_values("pos")
    total = int(rows["total"].iloc[0])
    top = _levels(list(rows["digest"]), total)[-1]
    return pd.DataFrame({
        "tree": rows["tree"].iloc[:1], "pos": rows["block"].iloc[:1], "total": [-(-total // BLOCK)], "digest": top,
    })


def _paths(levels, outer):
    """For each leaf of a superblock, the digests before and after it in its run, level by level up to the root."""
    paths = [outer]
    for level in reversed(levels[:-1]):
        above, paths = paths, []
        for i in range(len(level)):
            first = i - i % ARITY
            paths.append(["".join(level[first:i]), "".join(level[i + 1:first + ARITY]), *above[i // ARITY]])
    return paths


def _inner(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of the nodes of one superblock."""
    rows = rows.sort_values("pos")
    above = outer.iloc[0]
    levels = _levels(list(rows["digest"]), int(rows["total"].iloc[0]))
    return pd.DataFrame({
        "tree": rows["tree"], "pos": rows["pos"], "subroot": above["subroot"], "root": above["root"],
        "path": _paths(levels, list(above["path"])),
    })


def _proven(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one superblock, and the root to which each given leaf folds."""
    rows = rows.sort_values("pos")
    above = outer.iloc[0]
    paths = _paths(_levels(list(rows["digest"]), int(rows["total"].iloc[0])), list(above["path"]))
    folded = []
    for digest, path in zip(rows["given"], paths):
        for i in range(0, len(path), 2):
            digest = _digest((path[i], digest, path[i + 1]))
        folded.append(digest)
    return pd.DataFrame({
        "order": rows["order"], "group": rows["group"], "position": rows["pos"], "leaf": rows["digest"],
        "subroot": above["subroot"], "root": above["root"], "proof": paths, "folded_root": folded,
        "verified": [f == above["root"] for f in folded],
    })


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def _tiers(nodes: DataFrame, most: int) -> list:
    """``nodes`` (``tree, pos, total, digest``) and the tiers above them; the last has one node a tree."""
    tiers, schema = [nodes], "tree long, pos long, total long, digest string"
    while True:
        tiers.append(cut_lineage(_blocks(tiers[-1]).groupBy("tree", "block").applyInPandas(_node, schema)))
        most = -(-most // BLOCK)
        if most == 1:
            return tiers


def _descend(tiers: list, outer: DataFrame) -> DataFrame:
    """Paths of the nodes of the first tier; ``outer`` has those of the last one."""
    for nodes in reversed(tiers[:-1]):
        above = outer.withColumnRenamed("pos", "block").groupBy("tree", "block")
        inner = _blocks(nodes).groupBy("tree", "block").cogroup(above)
        outer = inner.applyInPandas(_inner, f"tree long, pos long, {OUTER}")
    return outer


def prove(documents: DataFrame, columns: list, group: str, order: str, presented: dict | None = None) -> DataFrame:
    """One row for each row of ``documents``, with its proof.

    ``order, group`` (columns of the input's names), ``position`` in the group, ``leaf``, ``subroot``,
    ``root``, ``proof`` (the digests before and after the node in its run, level by level up to the root),
    ``folded_root`` and ``verified``. ``presented`` maps columns to the values that are held against the
    manifest: their leaf is folded with the row's siblings. Without it rows are held against themselves.
    """
    presented = presented or {}
    original = leaf([F.col(f"`{c}`") for c in columns])
    given = leaf([presented.get(c, F.col(f"`{c}`")) for c in columns]) if presented else original
    rows = documents.select(
        F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), original.alias("digest"), given.alias("given")
    )
    types = dict(rows.dtypes)
    items = cut_lineage(rows.groupBy("group", "order", "digest", "given").agg(F.count("*").alias("n")))

    groups = items.groupBy("group").agg(F.sum("n").alias("total")).withColumn("one", F.lit(1).cast("long"))
    trees = cut_lineage(
        running_total(groups, [], [F.col("group").asc_nulls_first()], "one")
        .select(F.col("group").alias("name"), "total", F.col("_before").alias("tree"))
    )
    n_trees, most = trees.agg(F.count("*"), F.max("total")).first()
    named = items.join(few_enough(trees), F.col("group").eqNullSafe(F.col("name"))).drop("name")
    by_place = [F.col("order").asc_nulls_first(), "digest", "given"]
    placed = expand(running_total(named, ["tree"], by_place, "n"), "n", ["tree", "digest"])
    leaves = cut_lineage(placed.select(
        "tree", (F.col("_before") + F.col("_k")).alias("pos"), "total", "digest", "given",
        F.col("order").cast("string").alias("order"), F.col("group").cast("string").alias("group"),
    ))

    tiers = _tiers(leaves.select("tree", "pos", "total", "digest"), most or 1)
    subroots = tiers[-1].select("tree", "digest")
    tops = _tiers(
        subroots.select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("total"), "digest"
        ),
        max(n_trees, 1),
    )
    root = tops[-1].select("tree", "pos", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.expr("array()").cast("array<string>").alias("path"))
    above = _descend(tops, root).select(F.col("pos").alias("tree"), "root", "path")
    outer = above.join(subroots, "tree").select(
        "tree", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "path"
    )
    outer = _descend(tiers[1:], outer).withColumnRenamed("pos", "block")
    proven = _blocks(leaves).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        _proven,
        "`order` string, `group` string, position long, leaf string, subroot string, root string, "
        "proof array<string>, folded_root string, verified boolean",
    )
    own = [F.col("order").cast(types["order"]).alias(order), F.col("group").cast(types["group"]).alias(group)]
    return proven.select(*own, "position", "leaf", "subroot", "root", "proof", "folded_root", "verified")


def proof_digest(proof):
    """The digest of a proof's siblings, put together level by level."""
    return F.sha2(F.array_join(proof, "").cast("binary"), 256)
