"""Sharding by a hierarchical weighted hash tree.

A topology is a list of ``Leaf``: a shard, the region and rack it stands in, its weight, and the
generation in which that weight was added. A row descends region, rack and shard: on each level
every child draws an exponential number from the hash of the row's key and the child's path,
divided by the child's weight (the sum of the leaves below it), and the least draw wins. So a child
receives rows in proportion to its weight, and a change of weights moves rows only into nodes that
grew or out of nodes that shrank; inside all other subtrees nothing moves.

Weight added later is a generation of its own: a node of (generation, region) with its own racks
and leaves. A row that a region gains by new weight therefore descends through that new
weight only and never lands in an old shard: growing by any leaf moves rows into that leaf alone.
Shards of one region and several generations are still one region for the caller.

The law is ``key``: key and topology decide, nothing else does. Rows with one key (null is a key,
texts play no part) share a shard; so rows of the same id do, and equal texts of different ids need
not. Rows that repeat are rows of their own, with slots of their own. An empty table gives an empty
result. Only the key and what the caller selects is read; other columns come through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.columns import let
from assayline.session import checked_broadcast, materialise


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    generation: int = 0

    def __post_init__(self):
        if not self.weight > 0:
            raise ValueError(f"shard {self.shard} needs a weight above 0")


#: Shards of the first generation of ``uniform``, and how they are nested.
BASE_SHARDS = 8
SHARDS_OF_RACK = 2
RACKS_OF_REGION = 2


def uniform(count: int) -> list[Leaf]:
    """Shards 0 to count - 1 of equal weight: the first eight in two regions of two racks of two
    shards, each further one in the next rack in turn, as a generation of its own. Fewer than eight
    are a generation each, so only the step from seven to eight lays all shards out anew."""
    if count < 1:
        raise ValueError("at least one shard")
    leaves = []
    for shard in range(count):
        place = shard % BASE_SHARDS // SHARDS_OF_RACK
        grown = shard if shard >= BASE_SHARDS or count < BASE_SHARDS else 0
        leaves.append(Leaf(shard, place // RACKS_OF_REGION, place % RACKS_OF_REGION, generation=grown))
    return leaves


def _paths(leaf: Leaf) -> list[str]:
    """Names of the nodes from below the root to the leaf."""
    region = f"{leaf.generation}/{leaf.region}"
    rack = f"{region}/{leaf.rack}"
    return [region, rack, f"{rack}/{leaf.shard}"]


def _levels(leaves: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level: parent -> child -> weight."""
    names = [tuple(_paths(leaf)) for leaf in leaves]
    if len(set(names)) < len(names):
        raise ValueError("a shard has two leaves in one rack and generation")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf, path in zip(leaves, names):
        for level, (parent, child) in enumerate(zip(("", *path), path)):
            weights = levels[level].setdefault(parent, {})
            weights[child] = weights.get(child, 0.0) + leaf.weight
    return levels


def shard_of(key: list[Column], leaves: list[Leaf]) -> Column:
    """The shard of a row, from its key alone; the tree travels as literals."""

    def least(children: Column) -> Column:
        def draw(child: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(*key, child["path"]), 11)
            uniform_draw = (bits + F.lit(0.5)) * F.lit(2.0**-53)
            return F.struct((-F.ln(uniform_draw) / child["weight"]).alias("draw"), child["path"].alias("path"))

        return F.array_min(F.transform(children, draw))["path"]

    def entries(children: dict[str, float]) -> Column:
        return F.array(*[
            F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in children.items()
        ])

    def below(at: Column, level: dict[str, dict[str, float]]) -> Column:
        table = F.create_map(*[x for parent, kids in level.items() for x in (F.lit(parent), entries(kids))])
        return let(at, lambda parent: least(F.element_at(table, parent)))

    at = reduce(below, _levels(leaves), F.lit(""))
    shards = F.create_map(*[x for leaf in leaves for x in (F.lit(_paths(leaf)[-1]), F.lit(leaf.shard))])
    return F.element_at(shards, at).cast("int")


def assign(docs: DataFrame, leaves: list[Leaf], key: list[str], out: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row in column ``out``."""
    return docs.withColumn(out, shard_of([F.col(f"`{c}`") for c in key], leaves))


def with_slots(rows: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Adds each row's place in its shard, gapless from 0, in the given order (rows alike in it: any).

    Rows are dealt out by ranges of (shard, order), repeated rows included, so neither a shard nor a
    hot key is one task; a row's place is its place in the range plus what earlier ranges hold.
    """
    by = [shard, *order, "__tie"]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by)
    numbered = ranged.sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(
        numbered.withColumn("__part", F.shiftright("__at", 33)).drop("__tie"), "placed"
    )
    spans = placed.groupBy(shard, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.select(
        shard, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    joined = placed.join(checked_broadcast(offsets), [shard, "__part"])
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(out))


def write_shards(docs: DataFrame, leaves: list[Leaf], key: list[str], path: str) -> None:
    """Writes ``docs`` into one folder per shard (``shard=0``, ...), without a shuffle."""
    assign(docs, leaves, key, "shard").write.partitionBy("shard").parquet(path)
