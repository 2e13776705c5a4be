"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours (the larger or the smaller ones) are hung on the least node around it."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    met = around.join(least, F.col("a") == F.col("_a"))
    if large:
        hung = met.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        hung = met.filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` but the roots; the root is the component's least node.

    Alternates large-star and small-star steps until nothing changes: a number
    of rounds that grows with the logarithm of the size. Only least neighbours
    are aggregated, combined before the shuffle, so a node of any degree is
    never gathered in one task; the join back splits where a node is hot. Each
    round is a table in the shared folder. Loops and null ends are ignored.
    """
    kept = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        after = materialise(_star(_star(kept, True), False), "edges")
        now = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(kept)
        kept = after
        if now == mark or now[0] == 0:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
