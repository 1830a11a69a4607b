"""Best-fit packing of token sequences by patterns fitted to the length histogram.

Only the histogram of piece lengths (one count per possible length) reaches the driver. There
patterns of few lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares, rounded to whole numbers that the lengths left allow, and what is left is packed best-fit
decreasing, many equal lengths at a time. The plan is a list of (pattern, copies); its size
depends on the sequence length and not on the data.

Pieces find their places without meeting: a piece's number among those of its length comes from
counts by (length, bucket) and its order inside the bucket, and the plan gives each range of numbers its
sequences and offset. A length that a third of the pieces have is spread over ``BUCKETS`` groups or more.

Every row is a document, null text an empty one of just the end id; rows that share an id or
repeat are packed each by itself. Other columns are ignored. Texts are tokenised whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm import bpe, kernels
from assayline.session import materialise

SEQUENCE = 1024
END_ID = 2
BUCKETS = 256
MOST_BUCKETS = 4096  # the broadcast counts have size + 1 times as many numbers
BUCKET_PIECES = 1 << 16
FIT_STEPS = 1000
#: Lengths per pattern, fit after fit; a fit sees what rounding has left of the ones before.
FIT_ROUNDS = (2, 3, 3, 3)

_PIECES = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut
    from the back into pieces of ``size`` ids where there are more; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = batch.column(1).fill_null("")
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for a, b in kernels.chunks(texts):
                for row, ids in enumerate(encoder.encode(texts.slice(a, b - a).to_pylist()), a):
                    ids = np.concatenate((ids.astype("<u4"), end))
                    bounds = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    if len(ids) <= size:
                        bounds = [0, len(ids)]
                    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(row), numbers.append(number), starts.append(low)
                        lengths.append(high - low), sums.append(zlib.crc32(ids[low:high].data))
            yield pa.record_batch({
                "doc_id": batch.column(0).take(pa.array(rows, pa.int64())),
                "piece": pa.array(numbers, pa.int32()), "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
            })

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES.format(kind))


def few_length_patterns(size: int, count: int) -> np.ndarray:
    """All ways to fill ``size`` with ``count`` (two or three) lengths, one per row."""
    if count == 2:
        found = [(a, size - a) for a in range(1, size // 2 + 1)]
    else:
        found = [(a, b, size - a - b) for a in range(1, size // 3 + 1) for b in range(a, (size - a) // 2 + 1)]
    return np.array(found, np.int64).reshape(-1, count)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring A x near the histogram in least squares, A being how often
    a pattern takes a length. Each step solves for the one count with the steepest gradient, which
    keeps the solution sparse; it ends when no step changes a count by half a sequence."""
    norms = (patterns[:, :, None] == patterns[:, None, :]).sum((1, 2)).astype(float)  # columns of A
    rest = histogram.astype(float)
    counts = np.zeros(len(patterns))
    for _ in range(steps if len(patterns) else 0):
        gain = np.maximum(rest[patterns].sum(1) / norms, -counts)
        best = int(np.argmax(np.abs(gain) * np.sqrt(norms)))
        if abs(gain[best]) < 0.5:
            break
        counts[best] += gain[best]
        np.subtract.at(rest, patterns[best], gain[best])
    return counts


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal lengths go into equally full sequences together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size, 0, -1):
        left = int(histogram[length])
        while left:
            room = next((r for r in range(length, size) if open_.get(r)), size)
            pattern, copies = open_[room].pop() if room < size else ((), -(-left // (size // length)))
            each = min(room // length, -(-left // copies))  # of this length into each copy
            full = min(copies, left // each)
            if full < copies and room < size:
                open_[room].append((pattern, copies - full))
            open_.setdefault(room - each * length, []).append((pattern + (length,) * each, full))
            left -= full * each
    return [group for groups in open_.values() for group in groups]


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, copies)`` of all sequences; together they hold exactly the histogram.

    Every plan comes from one fit at least. Whichever number of fits leaves the fewest sequences once
    the rest is packed is taken, of equal ones the smallest number: where lengths hardly
    repeat, rounding makes later fits worth less than packing the rest.
    """
    left = histogram.astype(np.int64).copy()
    chosen, plans = [], []
    for count in FIT_ROUNDS:
        patterns = few_length_patterns(size, count)
        patterns = patterns[np.all(left[patterns] > 0, axis=1)]
        counts = np.rint(fit_counts(patterns, left)).astype(np.int64)
        for number in np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]:
            lengths = tuple(patterns[number].tolist())
            copies = min(int(counts[number]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if copies:
                chosen.append((lengths, copies))
                np.subtract.at(left, patterns[number], copies)
        plans.append(chosen + best_fit(left, size))
    return min(plans, key=lambda groups: sum(copies for _, copies in groups))


def _slots(sequences: list[tuple[tuple[int, ...], int]]) -> list[np.ndarray]:
    """Ranges of numbers within a length and where their sequences and offsets begin:
    length, low, first sequence, offset; ordered by length and low."""
    rows, taken, first = [], {}, 0
    for lengths, copies in sequences:
        offset = 0
        for v in lengths:
            low = taken.get(v, 0)
            rows.append((v, low, first, offset))
            taken[v] = low + copies
            offset += v
        first += copies
    ordered = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return list(ordered.T)


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Written ``pieces`` (column ``length``, 1 to ``size``) with ``sequence_id`` and ``offset``.

    Pieces of the full size are sequences by themselves and are numbered where they lie; the others are
    numbered within (length, bucket), with more buckets for more pieces.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    short = pieces.where(F.col("length") < size)
    buckets = min(MOST_BUCKETS, max(BUCKETS, pieces.count() // BUCKET_PIECES))
    bucketed = short.select(*own, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).alias("__bucket"))
    counts = np.zeros((size + 1, buckets), np.int64)  # the counts' table has no more rows than this
    for length, bucket, n in bucketed.groupBy("length", "__bucket").count().collect():
        counts[length, bucket] = n
    before = np.cumsum(counts, axis=1) - counts
    sequences = plan(counts.sum(1), size)
    taken = sum(copies for _, copies in sequences)
    lengths, lows, sequences, offsets = _slots(sequences)
    order = W.partitionBy("length", "__bucket").orderBy(*own)
    numbered = bucketed.withColumn("__number", F.row_number().over(order))
    sent = pieces.sparkSession.sparkContext.broadcast((before, lengths << 40 | lows, lows, sequences, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, keys, lows, sequences, offsets = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("__number").to_numpy() - 1
            number = number + before[length, batch.column("__bucket").to_numpy()]
            slot = np.searchsorted(keys, length << 40 | number, "right") - 1
            placed = pa.array(sequences[slot] + number - lows[slot]), pa.array(offsets[slot])
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, *placed], [*own, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*own).dtypes)
    placed = numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
    alone = (F.monotonically_increasing_id() + F.lit(taken)).alias("sequence_id")
    full = pieces.where(F.col("length") == size).select(*own, alone, F.lit(0).cast("bigint").alias("offset"))
    return placed.unionAll(full)


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """Every piece of every document with the sequence it goes to and its place in it."""
    return pack(materialise(token_pieces(docs, tokenizer, size, end_id), "pieces"), size)
