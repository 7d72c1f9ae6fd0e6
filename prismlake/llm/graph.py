"""Connected components of an edge table by repeated contraction.

Every node points to its smallest neighbour (or itself), pointers are followed to their
ends, and the edges are rewritten to these ends until none is left.
Nothing is gathered on the driver; every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root) for every node with an edge; the root is the
    node of its component where contraction ended, the same for all its nodes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(both.where("a <> b").distinct())
    found = materialize(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not left.isEmpty():
        up = _follow(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to")))
        before = found, left
        found = materialize(found.join(up, found["root"] == up["from"], "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = up.select(F.col("from").alias("b"), F.col("to").alias("to_b"))
        left = materialize(left.join(up, left["a"] == up["from"]).select("b", F.col("to").alias("to_a")).join(ends, "b")
                           .select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct())
        discard(up, *before)
    discard(left)
    return found


def _follow(pointers: DataFrame) -> DataFrame:
    """Every pointer followed to its end, twice as far with each step."""
    up = materialize(pointers.withColumn("moved", F.col("from") != F.col("to")))
    while not up.where("moved").isEmpty():
        further = up.select(F.col("from").alias("to"), F.col("to").alias("end"))
        nxt = materialize(up.join(further, "to").select("from", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
        discard(up)
        up = nxt
    return up
