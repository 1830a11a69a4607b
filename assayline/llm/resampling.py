"""Quality by importance resampling of hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hashed unigrams and bigrams are counted, one over the
target texts and one over all texts; a document's log weight is the log ratio of its probabilities under the
two, the sum over its n-grams. A Gumbel variate is added, and the documents with the largest sums are kept: a sample
without replacement with probabilities in proportion to the weights. (Xie et al. 2023, "Data Selection for
Language Models via Importance Resampling".)

Counts cover all documents; a task sends its two arrays of ``BUCKETS`` counts. The cut of the top k
is found exactly by counts over ever narrower ranges of the keys, so nothing is sorted as a whole.

Null and empty texts have weight 0 (ratio 1). The variate comes from a hash of id and text: rows
that repeat both get the same key and are kept or dropped by number only. A document is a target
if any of its labels has quality 1; null labels are none. Without target texts all weights are 0.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm import kernels
from assayline.llm.columns import text_digest
from assayline.session import materialise

BUCKETS = 10_000
SMOOTHING = 1.0
FRACTION = 0.5
SEED = 11


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a chunk, and the text each is of."""
    words = kernels.words_of(column, lower=True, punctuation=True)
    text = words.text_of_word()
    inside = np.flatnonzero(text[1:] == text[:-1])
    pairs = kernels.mix(words.hashes[inside] * np.uint64(3) + kernels.mix(words.hashes[inside + 1]))
    grams = np.concatenate((words.hashes, pairs))
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((text, text[inside]))


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of (all, target) texts by bucket, from columns ``text`` and ``target``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in kernels.chunks(batch.column(0)):
                buckets, text = gram_buckets(batch.column(0).slice(a, b - a))
                counts[0] += np.bincount(buckets, minlength=BUCKETS)
                counts[1] += np.bincount(buckets[target[a:b][text]], minlength=BUCKETS)
        model, bucket = np.nonzero(counts)
        yield pa.record_batch({
            "model": pa.array(model, pa.int32()), "bucket": pa.array(bucket, pa.int32()),
            "n": pa.array(counts[model, bucket]),
        })

    partial = texts.select("text", "target").mapInArrow(count, "model int, bucket int, n bigint")
    counts = np.zeros((2, BUCKETS))
    for row in partial.groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.model, row.bucket] = row.n  # 2 * BUCKETS rows at most
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, smoothed."""
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    smooth = counts + SMOOTHING
    raw, target = np.log(smooth) - np.log(smooth.sum(1, keepdims=True))
    return target - raw


def weighted(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, key)``: key is the log weight with its Gumbel variate."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            weights = np.zeros(len(texts))
            for a, b in kernels.chunks(texts):
                buckets, text = gram_buckets(texts.slice(a, b - a))
                weights[a:b] = np.bincount(text, sent.value[buckets], b - a)
            draws = kernels.mix(batch.column(2).to_numpy().view(np.uint64))
            uniform = ((draws >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            yield pa.record_batch({
                "doc_id": batch.column(0), "log_weight": pa.array(weights),
                "key": pa.array(weights - np.log(-np.log(uniform))),
            })

    kind = dict(docs.dtypes)["doc_id"]
    draw = F.xxhash64(F.lit(seed), "doc_id", text_digest(F.col("text")))
    return docs.select("doc_id", "text", draw.alias("draw")).mapInArrow(
        weigh, f"doc_id {kind}, log_weight double, key double"
    )


def top_k(rows: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The ``k`` rows of written ``rows`` with the largest values of a double column, exactly.

    The range of the k-th value is narrowed by counts over equal parts of it until one value or few
    rows are left; each count returns at most ``parts`` rows.
    """
    parts = 4096
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return rows.limit(0)
    if k >= n:
        return rows
    above = 0  # rows over ``high``, all of them kept
    while low < high:
        width = max((high - low) / parts, math.ulp(high))
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(parts - 1))
        inside = rows.where(F.col(key).between(low, high))
        counts = inside.groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        ).orderBy(F.desc("part")).collect()
        for row in counts:
            if above + row.n >= k:
                low, high = row.low, row.high
                break
            above += row.n
    certain = rows.where(F.col(key) > high)
    return certain.unionAll(rows.where(F.col(key) == high).limit(k - above))


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, key)`` of the sampled ``fraction`` of the rows (rounded up)."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("target")
    )
    # labels grow with the documents: a merge join at every size, never a broadcast
    flagged = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select(
        "text", F.coalesce("target", F.lit(False)).alias("target")
    )
    ratios = log_ratios(gram_counts(flagged))
    rows = materialise(weighted(docs, ratios, seed), "weights")
    return top_k(rows, math.ceil(fraction * rows.count()))
