"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.runtime import freeze


#: A key that holds this share of the rows of a join or more (of 1 / HOT) is hot.
HOT = 1000


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``side``, a written table with one row per key and the number of rows of that
    key as ``members``, which goes.

    The rows of a hot key stay where they are: of ``total`` rows at most ``HOT`` keys hold a ``HOT``-th, and
    their sides are broadcast. The other keys meet by an exchange.
    """
    many = F.col("members") >= max(2, total / HOT)
    hot, cold = F.broadcast(side.filter(many).drop("members")), side.filter(~many).drop("members")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def _least(edges: DataFrame) -> DataFrame:
    return freeze(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("members")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return join_hot(both.filter(F.col("v") > F.col("u")), _least(both), "u", 2 * total).select(
        F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (edges have u > v)."""
    least = _least(edges)
    return (
        join_hot(edges, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") > F.col("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without an edge are not listed.

    ``edges`` has the columns ``a`` and ``b`` of one orderable type; direction, repeated edges and
    loops do not matter. A hub's neighbours are combined on the map side, and its minimum is sent to
    where they are, so no task gathers a neighbourhood. Every star is a written table; the number of
    rounds grows with the logarithm of the number of nodes, and running out of rounds is an error.
    """
    now = freeze(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        large = freeze(_large_star(now, now.count()).distinct())
        now = freeze(_small_star(large, large.count()).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = state
    raise RuntimeError("components have not settled")
