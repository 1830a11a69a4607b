"""Approximate nearest neighbours in a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is put into one of its leaves. A query walks
the tree with a priority queue of nodes by inner product with their centroids, and the first leaves it
takes from the queue are the ones it visits. How many visits are needed is calibrated: for a bounded
sample of queries the exact neighbours are found by one scan of all rows, the ranks of their leaves
in the queries' own orders are noted, and visits are widened until the mean recall reaches
``RECALL``; with all leaves the search is exact.

Queries and rows meet in an equality join of blocks: neighbouring leaves of together about ``PART``
rows are a block, a larger leaf is dealt out into several, and the queries of a block likewise, so a leaf
that holds a third of all rows is many tasks. A block returns each query's k best rows in the leaves it visits. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest; the others
are left out of the parts, which loses nothing.

Nearness is the inner product in double precision, summed in the order of the components; ties go
to the smaller id. Vectors that are null, zero, of another length than most, or hold a null or
non-finite component, and rows without id, take no part. Rows that repeat id and vector count once; rows
that share only the id are separate candidates, and separate queries under one id. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.session import materialise

SAMPLE = 16_384
BRANCHES = 8
LEAF_ROWS = 512
#: A leaf keeps at least so many rows of the sample.
LEAF_SAMPLE = 8
CALIBRATION = 128
RECALL = 0.96
PART = 16_384
#: Queries compared with a block at a time.
STRIP = 256
SEED = 3


@dataclass
class Tree:
    """Nodes in breadth-first order; the children of a node lie side by side."""

    centroids: np.ndarray
    child: np.ndarray  # first child, -1 for a leaf
    count: np.ndarray  # children
    leaf: np.ndarray  # number of the leaf, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: from the root down to the nearest centroid."""
        node = np.zeros(len(vectors), np.int64)
        active = np.flatnonzero(self.child[node] >= 0)
        while len(active):
            for parent in np.unique(node[active]):
                rows = active[node[active] == parent]
                kids = np.arange(self.child[parent], self.child[parent] + self.count[parent])
                node[rows] = kids[_nearest(vectors[rows], self.centroids[kids])]
            active = active[self.child[node[active]] >= 0]
        return self.leaf[node]

    def visits(self, query_dots: np.ndarray, sizes: np.ndarray, wanted: int, least_rows: int) -> list[int]:
        """Leaves in the order in which the queue gives them, until ``wanted`` are taken and they
        hold ``least_rows`` rows. ``query_dots`` are the inner products with all centroids."""
        queue, taken, rows = [(0.0, 0)], [], 0
        while queue and (len(taken) < wanted or rows < least_rows):
            _, node = heapq.heappop(queue)
            if self.child[node] < 0:
                taken.append(int(self.leaf[node]))
                rows += int(sizes[self.leaf[node]])
            else:
                for kid in range(self.child[node], self.child[node] + self.count[node]):
                    heapq.heappush(queue, (-query_dots[kid], kid))
        return taken


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * vectors @ centroids.T, axis=1)


def _k_means(vectors: np.ndarray, k: int, draw, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and their number for each vector; empty clusters are dropped."""
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[draw.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = _nearest(vectors, centroids)
        centroids = np.stack([vectors[near == i].mean(0) for i in np.unique(near)])
    used, near = np.unique(_nearest(vectors, centroids), return_inverse=True)
    return centroids[used], near


def fit_tree(sample: np.ndarray, leaf_sample: int) -> Tree:
    draw = np.random.default_rng(SEED)
    centroids, child, count, members = [sample.mean(0)], [], [], [sample]
    at = 0
    while at < len(members):
        mine = members[at]
        child.append(-1), count.append(0)
        if len(mine) > leaf_sample and (mine != mine[0]).any():
            found, near = _k_means(mine, BRANCHES, draw)
            if len(found) > 1:
                child[at], count[at] = len(members), len(found)
                centroids += list(found)
                members += [mine[near == i] for i in range(len(found))]
        members[at] = None
        at += 1
    child = np.array(child)
    return Tree(np.stack(centroids), child, np.array(count), np.where(child < 0, np.cumsum(child < 0) - 1, -1))


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(id, vector, h1, h2)``: vectors of doubles that take part; h1 and h2 tell vectors apart."""
    vector = F.transform(vector_column, lambda x: x.cast("double"))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    # -0.0 is 0.0
    typed = rows.select(F.col(id_column).cast("bigint").alias("id"), vector.alias("vector")).where(finite)
    typed = typed.where(F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull())
    typed = typed.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    return typed.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component: equal vectors give equal sums."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def block_best(queries, query_ids, rows, ids, k: int, visited=None):
    """(query place, row place, score) of each query's k best rows of a block; ``visited`` says
    which rows (columns) a query (row) may see."""
    found = []
    for low in range(0, len(queries) if len(rows) else 0, STRIP):
        part, own = queries[low : low + STRIP], query_ids[low : low + STRIP]
        dots = part @ rows.T
        dots[own[:, None] == ids[None, :]] = -np.inf
        if visited is not None:
            dots[~visited[low : low + STRIP]] = -np.inf
        cut = np.full(len(part), -np.inf)
        if len(rows) > k:
            cut = np.partition(dots, len(rows) - k, axis=1)[:, len(rows) - k]
        # the order of summation may move a product by less than this
        slack = 1e-12 * np.linalg.norm(part, axis=1) * np.linalg.norm(rows, axis=1).max()
        q, r = np.nonzero((dots >= (cut - slack)[:, None]) & (dots > -np.inf))
        score = _exact(part[q], rows[r])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[first] + low, r[first], score[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def blocks_of(sizes: np.ndarray) -> np.ndarray:
    """Block of each leaf: neighbours that hold at most ``PART`` rows together."""
    block, held, out = -1, PART + 1, []
    for size in sizes.tolist():
        if held + size > PART:
            block, held = block + 1, 0
        held += size
        out.append(block)
    return np.array(out, np.int32)


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, Tree, np.ndarray]:
    """Written ``(id, vector, h1, h2, leaf)`` of the rows that can be among k nearest, the tree,
    and the number of such rows in each leaf."""
    widths = vectors.groupBy(F.size("vector").alias("width")).count()
    width = widths.orderBy(F.desc("count"), "width").limit(1).collect()
    if not width:
        return vectors.withColumn("leaf", F.lit(0)).limit(0), Tree(*[np.zeros(1, int)] * 4), np.zeros(1, int)
    vectors = vectors.where(F.size("vector") == width[0].width)
    same = W.partitionBy("h1", "h2").orderBy("id")
    once = W.partitionBy("h1", "h2", "id").orderBy("id")
    kept = vectors.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    kept = kept.withColumn("place", F.row_number().over(once)).where("place = 1").drop("place")
    kept = materialise(kept, "vectors")
    total = kept.count()
    sample = kept.orderBy(F.xxhash64("id"), "id", "h1").limit(SAMPLE).select("vector").toArrow()
    leaf_sample = max(LEAF_SAMPLE, LEAF_ROWS * sample.num_rows // total)
    tree = fit_tree(_matrix(sample.column(0)), leaf_sample)
    sent = kept.sparkSession.sparkContext.broadcast([tree.centroids, tree.child, tree.count, tree.leaf])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*sent.value)
        for batch in batches:
            leaf = pa.array(tree.assign(_matrix(batch.column("vector"))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    schema = "id bigint, vector array<double>, h1 bigint, h2 bigint, leaf int"
    index = materialise(kept.mapInArrow(assign, schema), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for row in index.groupBy("leaf").count().collect():  # one row per leaf
        sizes[row.leaf] = row["count"]
    return index, tree, sizes


def calibrate(index: DataFrame, queries: DataFrame, tree: Tree, sizes: np.ndarray, k: int) -> int:
    """Leaf visits with which sampled queries find ``RECALL`` of their exact neighbours."""
    found = queries.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(CALIBRATION).select("id", "vector").toArrow()
    if not found.num_rows:
        return 1
    ids, vectors = found.column("id").to_numpy(), _matrix(found.column("vector"))
    sent = index.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for batch in batches:
            rows, names = _matrix(batch.column("vector")), batch.column("id").to_numpy()
            q, r, score = block_best(vectors, ids, rows, names, k)
            yield pa.record_batch({
                "query": pa.array(q, pa.int32()), "id": pa.array(names[r]), "score": pa.array(score),
                "leaf": batch.column("leaf").take(pa.array(r)),
            })

    schema = "query int, id bigint, score double, leaf int"
    best = _first_k(index.mapInArrow(scan, schema), ["query"], k).select("query", "leaf")
    pairs = best.toArrow()  # CALIBRATION * k rows at most
    dots = vectors @ tree.centroids.T
    ranks = np.empty((len(ids), tree.leaves), np.int64)
    for i in range(len(ids)):
        ranks[i, tree.visits(dots[i], sizes, tree.leaves, 0)] = np.arange(tree.leaves)
    needed = np.sort(ranks[pairs.column("query").to_numpy(), pairs.column("leaf").to_numpy()])
    visits = 1
    while visits < tree.leaves and np.searchsorted(needed, visits) < RECALL * len(needed):
        visits += 1
    return visits


def _first_k(rows: DataFrame, query: list[str | Column], k: int) -> DataFrame:
    order = W.partitionBy(*query).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, tree: Tree, sizes: np.ndarray, visits: int, k: int) -> DataFrame:
    """``(query_id, rank, id, score)`` of each query's k nearest rows in the leaves it visits."""
    sent = index.sparkSession.sparkContext.broadcast([tree.centroids, tree.child, tree.count, tree.leaf])

    blocks = blocks_of(sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*sent.value)
        for batch in batches:
            rows, in_block, leaves = [], [], []
            for row, dots in enumerate(_matrix(batch.column("vector")) @ tree.centroids.T):
                taken = np.array(tree.visits(dots, sizes, visits, k + 1))
                for block in np.unique(blocks[taken]):
                    rows.append(row), in_block.append(block), leaves.append(taken[blocks[taken] == block])
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "vector", "h1")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(in_block, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                ["id", "vector", "h1", "block", "leaves"],
            )

    walked = materialise(queries.mapInArrow(
        walk, "id bigint, vector array<double>, h1 bigint, block int, leaves array<int>"
    ), "visits")
    count = int(blocks.max()) + 1
    row_parts = np.maximum(1, -(-np.bincount(blocks, sizes, count).astype(int) // PART))
    asked = np.zeros(count, np.int64)
    for row in walked.groupBy("block").count().collect():  # one row per block
        asked[row.block] = row["count"]
    query_parts = np.maximum(1, -(-asked // PART))
    spark = index.sparkSession
    parts = F.broadcast(spark.createDataFrame(  # one row per block
        list(zip(range(count), row_parts.tolist(), query_parts.tolist())), "block int, row_parts int, query_parts int"
    ))
    block_of_leaf = F.broadcast(spark.createDataFrame(  # one row per leaf
        list(enumerate(blocks.tolist())), "leaf int, block int"
    ))

    def dealt(rows: DataFrame, own: str, other: str, leaf: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id", "h1"), F.col(f"{own}_parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(f"{other}_part")
        return rows.join(parts, "block").select("id", "h1", "vector", leaf, "block", part.alias(f"{own}_part"), every)

    keys = ["block", "row_part", "query_part"]
    left = dealt(walked, "query", "row", "leaves").groupBy(*keys)
    right = dealt(index.join(block_of_leaf, "leaf"), "row", "query", "leaf").groupBy(*keys)

    def compare(asking: pa.Table, rows: pa.Table) -> pa.Table:
        ids, names = asking.column("id").to_numpy(), rows.column("id").to_numpy()
        lists = asking.column("leaves").combine_chunks()
        leaf = rows.column("leaf").to_numpy()
        first = int(leaf.min()) if len(leaf) else 0
        may = np.zeros((len(ids), int(leaf.max()) - first + 1 if len(leaf) else 1), bool)
        wanted, of = lists.flatten().to_numpy() - first, np.repeat(np.arange(len(ids)), lists.value_lengths())
        inside = (wanted >= 0) & (wanted < may.shape[1])
        may[of[inside], wanted[inside]] = True
        q, r, score = block_best(
            _matrix(asking.column("vector")), ids, _matrix(rows.column("vector")), names, k, may[:, leaf - first]
        )
        return pa.table({
            "query_id": pa.array(ids[q], pa.int64()), "h1": asking.column("h1").take(pa.array(q)),
            "id": pa.array(names[r], pa.int64()), "score": pa.array(score, pa.float64()),
        })

    schema = "query_id bigint, h1 bigint, id bigint, score double"
    near = left.cogroup(right).applyInArrow(compare, schema)
    return _first_k(near, ["query_id", "h1"], k).select("query_id", "rank", "id", "score")


def nearest(rows: DataFrame, query_filter: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, <id_column>, score)``: the ``k`` nearest found of every row that
    passes ``query_filter`` (over ``id``), among all rows but its own id."""
    vectors = valid_vectors(rows, id_column, vector_column)
    index, tree, sizes = build_index(vectors, k)
    queries = vectors.where(query_filter)
    if len(sizes) and sizes.sum():
        queries = queries.where(F.size("vector") == tree.centroids.shape[1])
    queries = queries.dropDuplicates(["id", "h1", "h2"])
    visits = calibrate(index, queries, tree, sizes, k)
    found = search(index, queries, tree, sizes, visits, k)
    return found.withColumnRenamed("id", id_column)
