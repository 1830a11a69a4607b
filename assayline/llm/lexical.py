"""Ranked lexical search by Block-Max MaxScore.

Documents are cut into index shards of at most ``SHARD_DOCS`` rows or ``SHARD_BYTES`` of text, in
the order of their ids inside. A shard holds, for every term of the queries, a posting list in
compressed blocks of ``BLOCK`` postings, each with its greatest term frequency and least document
length. Two numbers over all documents (rows with terms, and their terms) and one row per query
term (document frequency, greatest frequency, least length) turn these into upper bounds.

A task searches its shards one after the other and keeps one heap per query across them. A query's
lists are sorted by their global bounds; those whose bounds together stay below the heap's
last score are non-essential: a document in none of the other lists cannot enter. The
essential lists give the candidates; on the others the bound of the block a candidate would lie in
rejects it before any block is decompressed, and the rest are scored list by list. Bounds
never cut a tie, so the result is exact. The heaps of all tasks are merged by rank in two steps.

Queries are a stated set against all rows: their terms go to the tasks in blocks of about
``QUERY_BYTES``, one index for each block.

Terms: maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased,
of the whole text. Null and empty texts have none; such documents count nowhere, such queries
find nothing. Rows are documents: rows that repeat are ranked each by itself, those without id last
among equals. Queries that share an id are one query with the terms of all. A document's length
is a long, the product of three lengths is taken in integers of any size where 64 bits don't hold it.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.session import materialise

SHARD_DOCS = 8192
SHARD_BYTES = 32 << 20
BLOCK = 128
QUERY_BYTES = 4 << 20
MERGE_PARTS = 64

#: Bytes of terms: ASCII letters (as lower case), digits, and every byte of a longer character.
_TO_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_TERMS).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """``(item_id, term)`` of every query, once each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms_of(t.as_py()))) for t in batch.column(1).cast(pa.binary())]
            sizes = np.array([len(f) for f in found])
            yield pa.record_batch({
                "item_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))),
                "term": pa.array([t for f in found for t in f], pa.binary()).cast(pa.string()),
            })

    kind = dict(queries.dtypes)["item_id"]
    return queries.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, term string").distinct()


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as hold the largest, after that width."""
    top = int(values.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _widen(data: bytes, count: int) -> tuple[np.ndarray, bytes]:
    width = data[0]
    end = 1 + width * count
    return np.frombuffer(data[1:end], f"<u{width}").astype(np.int64), data[end:]


def _blocks(places: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """One posting list as compressed blocks: steps between places, then frequencies."""
    blocks = []
    for a in range(0, len(places), BLOCK):
        p, c = places[a : a + BLOCK], counts[a : a + BLOCK]
        blocks.append({
            "first": int(p[0]), "count": len(p), "top": int(c.max()), "least": int(sizes[p].min()),
            "data": _narrow(np.diff(p, prepend=p[0])) + _narrow(c),
        })
    return blocks


def _index(vocabulary: dict[bytes, int]):
    def shard(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        """Rows are (id, terms, {term number: frequency})."""
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        sizes = np.array([r[1] for r in rows], np.int64)
        held = [len(r[2]) for r in rows]
        numbers = np.fromiter((t for r in rows for t in r[2]), np.int64, sum(held))
        counts = np.fromiter((c for r in rows for c in r[2].values()), np.int64, sum(held))
        places = np.repeat(np.arange(len(rows)), held)
        order = np.argsort(numbers, kind="stable")
        numbers, counts, places = numbers[order], counts[order], places[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]))
        lists = [
            {
                "term": int(numbers[a]), "df": int(b - a), "top": int(counts[a:b].max()),
                "least": int(sizes[places[a:b]].min()), "blocks": _blocks(places[a:b], counts[a:b], sizes),
            }
            for a, b in zip(edges, edges[1:]) if b > a
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[r[0] for r in rows]], pa.list_(kind)), pa.array([sizes.tobytes()], pa.binary()),
                pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
                pa.array([lists], _LISTS),
            ],
            ["ids", "sizes", "docs", "terms", "lists"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            kind = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = value.as_py()
                words = terms_of(text)
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                rows.append((key, len(words), found))
                held += len(text or b"")
                if len(rows) == SHARD_DOCS or held >= SHARD_BYTES:
                    yield shard(rows, kind)
                    rows, held = [], 0
        if rows:
            yield shard(rows, kind)

    return build


_LIST_FIELDS = (
    "struct<term:int,df:bigint,top:bigint,least:bigint,"
    "blocks:array<struct<first:int,count:int,top:bigint,least:bigint,data:binary>>>"
)
_LISTS = pa.list_(pa.struct({
    "term": pa.int32(), "df": pa.int64(), "top": pa.int64(), "least": pa.int64(),
    "blocks": pa.list_(pa.struct({
        "first": pa.int32(), "count": pa.int32(), "top": pa.int64(), "least": pa.int64(), "data": pa.binary(),
    })),
}))


class Corpus(NamedTuple):
    docs: int  # with at least one term
    terms: int

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        """The length term of documents of so many terms."""
        if 50 * int(sizes.max()) * self.docs < 1 << 62:
            return 50 + 50 * sizes * self.docs // self.terms
        return np.array([50 + 50 * int(n) * self.docs // self.terms for n in sizes], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def _impact(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norms)


class _Lists:
    """The posting lists of one shard: bounds of all blocks, and blocks decompressed on demand."""

    def __init__(self, sizes: np.ndarray, lists: list[dict], weights: dict[int, int], corpus: Corpus):
        self.norms = corpus.norms(sizes)
        self.lists, self.open = {}, {}
        for entry in lists:
            blocks, weight = entry["blocks"], weights[entry["term"]]
            top, least = (np.array([b[k] for b in blocks], np.int64) for k in ("top", "least"))
            first = np.array([b["first"] for b in blocks], np.int64)
            self.lists[entry["term"]] = (blocks, weight, first, weight * _impact(top, corpus.norms(least)))

    def block(self, term: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of one block."""
        found = self.open.get((term, number))
        if found is None:
            blocks, weight, _, _ = self.lists[term]
            steps, rest = _widen(blocks[number]["data"], blocks[number]["count"])
            tf, _ = _widen(rest, blocks[number]["count"])
            places = blocks[number]["first"] + np.cumsum(steps)
            found = self.open[term, number] = places, weight * _impact(tf, self.norms[places])
        return found

    def search(self, terms: list[tuple[int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that reach ``floor``. ``terms`` are (bound, term) in
        ascending order of their global bounds."""
        held = [(bound, t) for bound, t in terms if t in self.lists]
        sums = np.cumsum([bound for bound, _ in held]) if held else np.zeros(0, np.int64)
        split = int(np.searchsorted(sums, floor, "left"))  # the first lists, which stay below together
        scores = np.zeros(len(self.norms), np.int64)
        for _, term in held[split:]:
            for number in range(len(self.lists[term][0])):
                places, gain = self.block(term, number)
                scores[places] += gain
        at = np.flatnonzero(scores)
        score, rest = scores[at], held[:split][::-1]
        if rest and len(at):  # what the blocks a candidate would lie in could add at most
            limits, where = np.zeros((len(rest), len(at)), np.int64), []
            for i, (_, term) in enumerate(rest):
                _, _, first, bounds = self.lists[term]
                where.append(np.searchsorted(first, at, "right") - 1)
                limits[i] = np.where(where[i] >= 0, bounds[where[i]], 0)
            left = limits.sum(0)
            for i, (_, term) in enumerate(rest):
                alive = score + left >= floor
                at, score, left, limits = at[alive], score[alive], left[alive], limits[:, alive]
                where = [w[alive] for w in where]
                left = left - limits[i]
                for number in np.unique(where[i][where[i] >= 0]).tolist():
                    places, gain = self.block(term, number)
                    mine = np.flatnonzero(where[i] == number)
                    spot = np.minimum(np.searchsorted(places, at[mine]), len(places) - 1)
                    hit = places[spot] == at[mine]
                    score[mine[hit]] += gain[spot[hit]]
        keep = score >= floor
        return at[keep], score[keep]


def _search(queries: pa.Table, vocabulary: dict[str, int], stats: dict[int, tuple], corpus: Corpus, count: int):
    """Search all shards of a task for the rows (item_id, terms) of ``queries``."""
    weights = {t: corpus.weight(df) for t, (df, _, _) in stats.items()}
    bounds = {
        t: weights[t] * int(_impact(np.int64(top), corpus.norms(np.array([least], np.int64))[0]))
        for t, (_, top, least) in stats.items()
    }
    numbers = [[vocabulary[t] for t in terms] for terms in queries.column("terms").to_pylist()]
    plans = [sorted((bounds[t], t) for t in terms if weights.get(t)) for terms in numbers]
    items = queries.column("item_id").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in plans]
        kind = None
        for batch in batches:
            kind = batch.column(0).type.value_type
            for row in range(len(batch)):
                ids = batch.column(0)[row].values
                sizes = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                shard = _Lists(sizes, batch.column(2)[row].as_py(), weights, corpus)
                for number, (plan, heap) in enumerate(zip(plans, heaps)):
                    floor = -heap[-1][0] if len(heap) == count else 1
                    at, score = shard.search(plan, floor)
                    best = np.lexsort((at, -score))[:count]
                    names = ids.take(pa.array(at[best])).to_pylist()
                    found = [(-s, n is None, n) for s, n in zip(score[best].tolist(), names)]
                    if found:
                        heaps[number] = sorted(heap + found)[:count]
        if kind is not None:
            held = np.repeat(np.arange(len(heaps)), [len(h) for h in heaps])
            yield pa.record_batch({
                "item_id": items.take(pa.array(held)),
                "doc_id": pa.array([n for heap in heaps for _, _, n in heap], kind),
                "score": pa.array([-s for heap in heaps for s, _, _ in heap], pa.int64()),
            })

    return run


def _answers(docs: DataFrame, queries: pa.Table, count: int, item_kind: str) -> DataFrame:
    """The heaps of all tasks for one block of queries, from an index of their terms."""
    words = sorted({t for terms in queries.column("terms").to_pylist() for t in terms})
    vocabulary = {t: i for i, t in enumerate(words)}
    kind = dict(docs.dtypes)["doc_id"]
    index = materialise(docs.select("doc_id", "text").mapInArrow(
        _index({t.encode(): i for t, i in vocabulary.items()}),
        f"ids array<{kind}>, sizes binary, docs bigint, terms bigint, lists array<{_LIST_FIELDS}>",
    ), "lexical-index")
    total = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    corpus = Corpus(total["docs"] or 0, total["terms"] or 0)
    facts = index.select(F.inline(F.transform(
        "lists", lambda x: F.struct(x["term"].alias("term"), x["df"].alias("df"), x["top"].alias("top"), x["least"].alias("least"))
    ))).groupBy("term").agg(F.sum("df"), F.max("top"), F.min("least"))
    stats = {r[0]: (r[1], r[2], r[3]) for r in facts.collect()}  # at most one row per query term
    return index.select("ids", "sizes", "lists").mapInArrow(
        _search(queries, vocabulary, stats, corpus, count), f"item_id {item_kind}, doc_id {kind}, score bigint"
    )


def _merged(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each query by rank; heaps meet in ``MERGE_PARTS`` parts first."""
    order = [F.col("score").desc(), F.col("doc_id").isNull(), "doc_id"]
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    rank = F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))
    kept = parts.withColumn("rank", rank).where(F.col("rank") <= count)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(*order))
    return kept.withColumn("rank", rank).where(F.col("rank") <= count).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``count`` best documents of each query with a score
    above 0, highest first, equal scores by ascending id."""
    terms = materialise(query_terms(queries), "query-terms")
    size = terms.agg(F.sum(F.octet_length("term") + F.lit(8))).first()[0] or 0
    blocks = 1 + size // QUERY_BYTES
    item_kind = dict(queries.dtypes)["item_id"]
    found = None
    for number in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        asked = block.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).toArrow()
        part = _answers(docs, asked, count, item_kind)
        found = part if found is None else found.unionAll(part)
    return _merged(found, count)
