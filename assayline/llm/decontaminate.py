"""Benchmark decontamination by pigeonhole edit matching.

An item is found in a document if some stretch of the document is within the item's error
budget of edits (insertions, deletions, substitutions). Both are compared without white space,
ASCII punctuation and case, as UTF-8 bytes, so re-wrapped or re-punctuated passages are exact.
With a budget of e edits, an item is cut into e + 1 pieces of which at least one must occur
unchanged: an automaton finds all piece hits in one scan of the text, every hit names the stretch
in which the whole item would lie, overlapping stretches are merged, and Myers' bit-parallel
distance decides each. No match within the budget is lost.

The benchmark is a stated query set against all rows: its items go to the tasks in blocks of
about ``BLOCK_BYTES`` normalised bytes, one scan of the documents per block, so what is sent to
a task has a bound however many items there are.

Items of fewer than ``MIN_ITEM_BYTES`` normalised bytes (a null text has none) match nothing:
a stray word is no leak; ``unmatched_items`` lists them. Rows that repeat are judged each by itself; items that share an id are
reported under it once. Other columns are ignored. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per normalised byte of an item.
ERROR_RATE = 0.08
MIN_ITEM_BYTES = 32
BLOCK_BYTES = 1 << 20

_DROPPED = (string.punctuation + string.whitespace).encode()


def normalise(text: str) -> bytes:
    """Case-folded UTF-8 without white space and ASCII punctuation."""
    return text.lower().encode().translate(None, _DROPPED)


def error_budget(size: int, rate: float = ERROR_RATE) -> int:
    return int(size * rate)


def pieces(size: int, budget: int) -> list[tuple[int, int]]:
    """Spans of budget + 1 pieces of nearly equal length."""
    edges = [size * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(edges, edges[1:]))


def myers_best(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where the first such
    stretch ends. (Myers 1999: one column of vertical differences in two bit vectors.)"""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        carried = eq | minus
        plus = down | ~(carried | up) & full
        minus = up & carried
        if score < best:
            best, end = score, at
            if not best:
                break
    return best, end


class Matcher:
    """The piece automaton of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = items
        self.budgets = [error_budget(len(text), rate) for _, text in items]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            for low, high in pieces(len(text), self.budgets[number]):
                wanted.setdefault(text[low:high].decode("latin-1"), []).append((number, high))
        self.automaton = ahocorasick.Automaton()
        for piece, places in wanted.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def stretches(self, text: bytes) -> dict[int, list[list[int]]]:
        """Merged stretches per item in which it may lie."""
        found: dict[int, list[list[int]]] = {}
        for last, places in self.automaton.iter(text.decode("latin-1")):
            for number, high in places:
                budget, size = self.budgets[number], len(self.items[number][1])
                low = max(0, last + 1 - high - budget)
                stop = last + 1 - high + size + budget
                open_ = found.setdefault(number, [])
                if open_ and low <= open_[-1][1]:
                    open_[-1][0] = min(open_[-1][0], low)
                    open_[-1][1] = max(open_[-1][1], stop)
                else:
                    open_.append([low, stop])
        return found

    def matches(self, text: bytes) -> list[tuple[int, int]]:
        """``(item_id, edits)`` of every item within its budget, the least edits of each."""
        best: dict[int, int] = {}
        for number, places in self.stretches(text).items():
            item, pattern = self.items[number]
            edits = min(myers_best(pattern, text[low:stop])[0] for low, stop in places)
            if edits <= self.budgets[number]:
                best[item] = min(edits, best.get(item, edits))
        return sorted(best.items())


def _normalised(benchmark: DataFrame) -> DataFrame:
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalise(t) for t in batch.column(1).fill_null("").to_pylist()]
            yield pa.record_batch({"item_id": batch.column(0), "text": pa.array(texts, pa.binary())})

    rows = benchmark.select(F.col("item_id").cast("bigint"), "text")
    return rows.mapInArrow(convert, "item_id bigint, text binary")


def unmatched_items(benchmark: DataFrame, min_bytes: int = MIN_ITEM_BYTES) -> DataFrame:
    """``(item_id, n_bytes)`` of the items that match nothing, being shorter than ``min_bytes`` or
    without an id."""
    items = _normalised(benchmark).select("item_id", F.length("text").alias("n_bytes"))
    return items.where(F.col("item_id").isNull() | (F.col("n_bytes") < min_bytes))


def _blocks(benchmark: DataFrame, min_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items in the order of their ids, about ``BLOCK_BYTES`` at a time through the driver;
    what shares an id is in one block."""

    items = _normalised(benchmark).where(F.length("text") >= min_bytes).where("item_id is not null").distinct()
    block, size = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        if size >= BLOCK_BYTES and row.item_id != block[-1][0]:
            yield block
            block, size = [], 0
        block.append((row.item_id, bytes(row.text)))
        size += len(row.text)
    if block:
        yield block


_MATCHES = "doc_id {}, item_id bigint, edits int, budget int"


def _scan(docs: DataFrame, block: list[tuple[int, bytes]], rate: float) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    kind = dict(docs.dtypes)["doc_id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate)
        budget: dict[int, int] = {}
        for (item, _), allowed in zip(matcher.items, matcher.budgets):
            budget[item] = max(allowed, budget.get(item, 0))
        for batch in batches:
            rows, items, edits = [], [], []
            for row, text in enumerate(batch.column(1)):
                if text.is_valid:
                    for item, least in matcher.matches(normalise(text.as_py())):
                        rows.append(row), items.append(item), edits.append(least)
            yield pa.record_batch({
                "doc_id": batch.column(0).take(pa.array(rows, pa.int64())),
                "item_id": pa.array(items, pa.int64()), "edits": pa.array(edits, pa.int32()),
                "budget": pa.array([budget[i] for i in items], pa.int32()),
            })

    return docs.select("doc_id", "text").mapInArrow(search, _MATCHES.format(kind))


def _pass(docs: DataFrame, block: list[tuple[int, bytes]], rate: float) -> DataFrame:
    """The rows in which no item of the block is found."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            texts = batch.column("text")
            keep = [not (t.is_valid and matcher.matches(normalise(t.as_py()))) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_bytes: int = MIN_ITEM_BYTES
) -> DataFrame:
    """``(doc_id, item_id, edits, budget)``: every item found in a document, once per row."""
    found = None
    for block in _blocks(benchmark, min_bytes):
        part = _scan(docs, block, rate)
        found = part if found is None else found.unionAll(part)
    if found is None:
        kind = dict(docs.dtypes)["doc_id"]
        return docs.sparkSession.createDataFrame([], _MATCHES.format(kind))
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_bytes: int = MIN_ITEM_BYTES
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; no shuffle."""
    kept = docs
    for block in _blocks(benchmark, min_bytes):
        kept = _pass(kept, block, rate)
    return kept
