"""Connected components of an edge list, as alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every step is a
grouped minimum and a join on the node, written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.columns import salted
from assayline.session import materialise


SALTS = 16


def _towards_minimum(arcs: DataFrame) -> DataFrame:
    """Arcs (a, b): every b joined to the least of a and all its b; the hub of a star meets its
    arcs in ``SALTS`` parts."""
    least = salted(arcs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), SALTS)
    parts = arcs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    return parts.join(least, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = _towards_minimum(both).where("b > a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _towards_minimum(down)
    moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
    ).first())


def component_of(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node with an edge; the component is its least node.

    ``edges`` has two columns a and b of one type that can be ordered; direction, loops and repeats
    don't matter.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = materialise(_small_star(materialise(_large_star(edges), "edges")), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component")).distinct()
