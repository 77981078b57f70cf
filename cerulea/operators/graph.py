"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cerulea.sinks.shared import stored

#: Parts in which the neighbours of a node meet its smallest neighbour.
SALTS = 16
#: Up to so many edges, a round sends the smallest neighbours of all nodes to every task instead; there are no more of them than twice the edges.
BROADCAST_EDGES = 100_000


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, stored, and their number and checksum, which are observed while they are written."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")), "edges")
    return out, seen.get


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), of any type that has an order: root is the smallest node it can reach.

    Alternating large and small stars: each round links nodes to the smallest of their neighbours, until only stars around the smallest nodes are left.
    The number of rounds grows with the logarithm of the longest path. Every round is written to the shared folder, so lineage stays short; only
    a count and a checksum come to the driver. No edges give no rows.
    """

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))

    def beside(rows: DataFrame, low: DataFrame) -> DataFrame:
        """(u, v, low). The neighbours of a hub are dealt over several tasks; with a plain exchange on both sides, adaptive execution can split them further."""
        if now["n"] <= BROADCAST_EDGES:
            return rows.join(F.broadcast(low), "u")
        copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), ["u", "salt"]).drop("salt")

    def both(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("a").alias("u"), F.col("b").alias("v")).union(rows.select(F.col("b"), F.col("a")))

    def tidy(rows: DataFrame) -> DataFrame:
        return rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    (edges, now), before = _written(tidy(edges.select("a", "b"))), None
    while now["n"] and now != before:
        before = now
        sides = both(edges)
        large = tidy(beside(sides, least(sides)).where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = least(down)
        small = beside(down, low).select(F.col("v").alias("a"), F.col("low").alias("b")).union(low.select(F.col("u"), F.col("low")))
        edges, now = _written(tidy(small))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
