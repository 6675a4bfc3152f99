"""Connected components of an edge table, distributed.

Alternating large-star and small-star rounds until the edges form stars. Each
round is two minimum aggregations (combined on the map side) and two joins. A
node that holds many edges, which star rounds make on purpose, is joined by
broadcast (there are fewer than a thousand that hold a thousandth of all edges), so
no hub meets in one task. A round ends in a written table, so a lost executor costs one
round at most, and the table before it is removed. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written


def checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` (a long, b long) -> one row (node, root) for every node but the roots; root is the smallest node.

    Loops, repeated edges and either direction are fine. No edges: no rows.
    """
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = checksum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n")).select("a", F.least("a", "m").alias("m"), "__n")
        large = written(
            spread_join(both, least, "a", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n"))
        small = spread_join(large, lowest, "a", before[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        made = written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = checksum(made)
        discard(e, large)
        e = made
        if after == before:
            break
        before = after
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._plumbline_path = e._plumbline_path
    return out
