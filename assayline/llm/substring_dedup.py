"""Substring deduplication: count-min sketches first, exact grouping of the rest second.

A window is ``WINDOW`` consecutive words of one document. It goes if its words also start
earlier: in a document with a smaller (doc_id, text digest), or earlier in the same one. All
words under a window that goes are removed; windows are judged on the input alone.

First pass. Every window is represented by its anchor, the run of ``GRAM`` words in it with the
smallest hash. Equal windows have equal anchors at equal places, so a window occurs at most as
often as its anchor is selected: a count of anchors overestimates the count of windows, with
about a seventh of the entries. Each task makes a count-min sketch of its anchors (two
rows of ``CELLS`` cells, kept sparse), the sketches are added up by ranges of cells, and what
is broadcast is one bit per cell, "counted at least twice": 2 * CELLS / 8 bytes at any size of the
data. On data too large for the sketch more windows pass and the second pass does more; none is lost.

Second pass. Windows whose two bits are set get 96 bits of hash. Each block of about
``BLOCK_WINDOWS`` windows keeps the first of equal ones and settles the others at once, so a window
that a third of the documents hold reaches the shuffle once per block. The rest are grouped exactly.

Ids are integers (others fail in the cast to bigint). Null text has no words. Rows with the same id and text count as one document and get the same
result; a null id sorts last. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm import kernels
from assayline.llm.columns import same_row, text_digest

WINDOW = 20
GRAM = 8
CELLS = 1 << 27
SHARD_BITS = 20
BLOCK_WINDOWS = 1 << 19
_ROW = ["doc_id", "digest"]


def _digest() -> Column:
    """Tells rows of one id apart; 32 bits are enough for that."""
    return text_digest(F.col("text")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _anchors(words: kernels.Words, window: int, gram: int):
    """Start of every whole window, the place and the hash of its anchor."""
    n = len(words.starts)
    if n < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    grams = kernels.span_hashes(words.hashes, at, at + gram, kernels.WORD_BASES[0])
    # the low bits of what is compared are the place, so that the minimum brings it along; it
    # is counted from a start common to the window only, hence leftmost among equal hashes
    width = window - gram + 1
    low = _sliding_min(grams, width)
    place = np.full(len(low), -1, np.int64)
    for offset in range(width - 1, -1, -1):
        hit = grams[offset : offset + len(low)] == low
        place[hit] = np.flatnonzero(hit) + offset
    text = words.text_of_word()
    whole = text[: n - window + 1] == text[window - 1 :]
    starts = np.flatnonzero(whole)
    return starts, place[starts], low[starts]


def _cells(anchors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (anchors & mask).astype(np.int64), ((anchors >> np.uint64(32)) & mask).astype(np.int64) + cells


def _sketch_rows(cells: np.ndarray) -> pa.RecordBatch:
    """The cells of a partial sketch with what they count (up to 2), by ranges of cells."""
    found, counts = np.unique(cells, return_counts=True)
    entries = ((found & ((1 << SHARD_BITS) - 1)) << 1 | (counts > 1)).astype("<u4")
    shards, begin = np.unique(found >> SHARD_BITS, return_index=True)
    parts = [part.tobytes() for part in np.split(entries, begin[1:])] if len(found) else []
    return pa.record_batch({"shard": pa.array(shards, pa.int32()), "entries": pa.array(parts, pa.binary())})


def repeated_cells(rows: DataFrame, window: int, gram: int, cells: int) -> np.ndarray:
    """One bit per cell of the merged sketch: counted at least twice."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for a, b in kernels.chunks(batch.column(0)):
                words = kernels.words_of(batch.column(0).slice(a, b - a))
                _, places, anchors = _anchors(words, window, gram)
                if not len(places):
                    continue
                _, selected = np.unique(places, return_index=True)
                waiting += _cells(anchors[selected], cells)
                size += 2 * len(selected)
                if size >= 1 << 21:
                    yield _sketch_rows(np.concatenate(waiting))
                    waiting, size = [], 0
        if waiting:
            yield _sketch_rows(np.concatenate(waiting))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = counted.setdefault(shard, np.zeros(1 << SHARD_BITS, np.uint8))
                entries = np.frombuffer(part, "<u4")
                at = entries >> 1  # every cell once in an entry list
                counts[at] = np.minimum(counts[at] + 1 + (entries & 1), 2)
        for shard, counts in counted.items():
            bits = np.packbits(counts > 1, bitorder="little").tobytes()
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "bits": pa.array([bits], pa.binary())})

    partial = rows.select("text").mapInArrow(sketch, "shard int, entries binary")
    merged = partial.repartition("shard").mapInArrow(merge, "shard int, bits binary")
    bitmap = np.zeros(2 * cells // 8, np.uint8)
    width = (1 << SHARD_BITS) // 8
    for row in merged.toLocalIterator():  # at most 2 * cells bits in all
        bitmap[row.shard * width : (row.shard + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def _ranges(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Sorted window starts as disjoint word ranges."""
    breaks = np.flatnonzero(np.diff(starts) > window)
    lows = starts[np.concatenate(([0], breaks + 1))]
    highs = starts[np.concatenate((breaks, [len(starts) - 1]))] + window
    return list(zip(lows.tolist(), highs.tolist()))


_CANDIDATES = pa.schema([
    ("doc_id", pa.int64()), ("digest", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
    ("h1", pa.int64()), ("h2", pa.int32()), ("settled", pa.bool_()),
])


def _settle(ids, digests, rows, starts, h1, h2, window) -> Iterator[pa.RecordBatch]:
    """First occurrences of a block as candidates, the others as removed ranges.

    ``ids`` (masked where null) and ``digests`` belong to the block's documents, ``rows``
    says which document a window is of.
    """
    known = np.array([i is None for i in ids])
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.empty(len(ids), np.int64)
    keys = np.lexsort((digests, numbers, known))
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        same[1:] = np.all([x[keys][1:] == x[keys][:-1] for x in (digests, numbers, known)], axis=0)
    order[keys] = np.cumsum(~same)
    sort = np.lexsort((starts, order[rows], h2, h1))
    a, b = h1[sort], h2[sort]
    place = np.stack((order[rows][sort], starts[sort]))
    new = np.ones(len(sort), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(sort)), 0))
    later = np.any(place != place[:, head], axis=0)
    first, gone = np.sort(sort[new]), sort[later]
    yield _batch(ids, digests, rows[first], starts[first], np.zeros(len(first), int), h1[first], h2[first], False)
    gone = gone[np.lexsort((starts[gone], rows[gone]))]
    spans = []
    for part in np.split(gone, np.flatnonzero(np.diff(rows[gone])) + 1):
        if len(part):
            spans += [(rows[part[0]], low, high) for low, high in _ranges(starts[part], window)]
    if spans:
        at, low, high = np.array(spans, np.int64).T
        # nothing is looked for with these; their hashes only deal them out
        h1 = kernels.mix(digests[at].astype(np.uint64) << np.uint64(32) ^ low.astype(np.uint64))
        yield _batch(ids, digests, at, low, high, h1, h1, True)


def _batch(ids, digests, rows, low, high, h1, h2, settled) -> pa.RecordBatch:
    doc_ids = pa.array(ids, pa.int64()).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([
        doc_ids, pa.array(digests[rows]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
        pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)),
        pa.array(np.full(len(rows), settled)),
    ], schema=_CANDIDATES)


def repeated_windows(docs: DataFrame, window: int, gram: int, cells: int) -> DataFrame:
    """``(doc_id, digest, start, stop, h1, h2, settled)``: ranges settled inside a block, and
    the windows left to be grouped (their stop is 0, which takes no room in the shuffle)."""
    rows = docs.select("text", F.col("doc_id").cast("bigint"), _digest().alias("digest"))
    sketch = rows.sparkSession.sparkContext.broadcast(repeated_cells(rows, window, gram, cells))

    def passing(words: kernels.Words):
        starts, _, anchors = _anchors(words, window, gram)
        bits = sketch.value
        keep = np.ones(len(starts), bool)
        for cell in _cells(anchors, cells):
            keep &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        starts = starts[keep]
        h1, h2 = (
            kernels.span_hashes(words.hashes, starts, starts + window, base) for base in kernels.WORD_BASES
        )
        return starts, h1, h2

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, parts, size = [], [], [], 0

        def block():
            columns = [np.concatenate(x) for x in zip(*parts)]
            return _settle(ids, np.concatenate(digests), *columns, window)

        for batch in batches:
            for a, b in kernels.chunks(batch.column(0)):
                words = kernels.words_of(batch.column(0).slice(a, b - a))
                starts, h1, h2 = passing(words)
                if not len(starts):
                    continue
                text = np.searchsorted(words.first, starts, "right") - 1
                parts.append((text + len(ids), starts - words.first[text], h1, h2))
                ids += batch.column(1).slice(a, b - a).to_pylist()
                digests.append(batch.column(2).slice(a, b - a).to_numpy())
                size += len(starts)
                if size >= BLOCK_WINDOWS:
                    yield from block()
                    ids, digests, parts, size = [], [], [], 0
        if parts:
            yield from block()

    return rows.mapInArrow(
        candidates,
        "doc_id bigint, digest int, start int, stop int, h1 bigint, h2 int, settled boolean",
    )


def removed_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """``(doc_id, digest, ranges)``: the word ranges to remove, unsorted and overlapping, each a
    bigint of start (upper half) and stop."""
    found = repeated_windows(docs, window, gram, cells)
    order = W.partitionBy("settled", "h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "digest", "start")
    gone = found.withColumn("place", F.rank().over(order)).where("settled or place > 1")
    stop = F.when(F.col("settled"), F.col("stop")).otherwise(F.col("start") + window)
    span = F.shiftleft(F.col("start").cast("bigint"), 32) + stop
    return gone.groupBy(*_ROW).agg(F.collect_list(span).alias("ranges"))


def _deflated(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, text) with the text deflated, half the size in a shuffle."""

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).fill_null("").cast(pa.binary())
            packed = [zlib.compress(t.as_py(), 1) for t in texts]
            yield pa.record_batch({
                "doc_id": batch.column(0), "digest": batch.column(1), "packed": pa.array(packed, pa.binary())
            })

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(deflate, f"doc_id {kind}, digest int, packed binary")


def _kept_words(text: bytes, ranges) -> tuple[int, int, bytes]:
    words = text.split()
    if ranges is None:
        return len(words), 0, b" ".join(words)
    starts, stops = ranges
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    keep = np.cumsum(change[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, kept_sha256)`` of every row; ``kept`` is the kept
    words joined by one space."""
    left = _deflated(docs.select("doc_id", _digest().alias("digest"), "text")).alias("l")
    right = removed_ranges(docs, window, gram, cells).alias("r")
    joined = left.join(right, same_row("l", "r", _ROW), "left").select("l.doc_id", "l.packed", "r.ranges")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            sizes, gone, kept, digests = [], [], [], []
            for text, spans in zip(texts, lists):
                ranges = None
                if spans.is_valid:
                    flat = spans.values.to_numpy()
                    ranges = flat >> 32, flat & 0xFFFFFFFF
                n, removed, words = _kept_words(zlib.decompress(text.as_py()), ranges)
                sizes.append(n), gone.append(removed), kept.append(words)
                digests.append(hashlib.sha256(words).hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array(digests, pa.string()),
            })

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(
        apply, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string"
    )
