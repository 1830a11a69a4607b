"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is one or more lanes of 64 bits. Fingerprints within ``distance`` bits, cut into
distance // 2 + 1 segments, have a segment in which they differ by at most one bit. Each distinct
fingerprint is therefore indexed under all its segments with one bit struck out (a variant for each
bit); fingerprints with an equal variant meet in an equality exchange, and their full distance is
verified. With fewer segments than that (``segments`` per lane may be set) pairs of larger distance are
found by chance only, but the chance is high: 0.93 for 19 of 128 bits in eight segments. Among fingerprints that meet, only a
spanning forest of the links is returned, found by comparing sorted neighbours at growing offsets
until all are connected; so a dense group costs little and emits fewer links than members, and no link is lost
to reachability. Copies never meet: they are one fingerprint.

Of N fingerprints about 64 * lanes * N / 2**(64 / segments - 1) meet a given one by chance; this is
what bounds the number of segments for a corpus.

Null text and text without words have fingerprint zero and are linked like others. Rows are
not merged; rows that share an id keep their own fingerprints. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm import kernels
from assayline.llm.columns import salted, text_digest, whole_row
from assayline.llm.components import component_of
from assayline.session import materialise

SHINGLE_WORDS = 3
DISTANCE = 2
SEED = 42
SALTS = 16


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words (fewer words: of all), A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    count = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: count - 1] + 1)).tolist()
    stops = ends[-count:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, count)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each group of ``sizes`` hashes: the bits set in over half of them; 0 if empty.

    Bits are counted eight at a time in the bytes of 64-bit sums over at most 255 hashes.
    """
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if not len(full):
        return out
    begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    blocks = -(-sizes[full] // 255)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    at = np.repeat(begin - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            over = 2 * counts[:, byte] > sizes[full]
            out[full] |= over.astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, lanes: int = 1) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is a signed 64-bit integer, or an array of ``lanes`` of
    them. Lanes after the first take their bits from a mix of the shingle's hash."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.binary())
            for a, b in kernels.chunks(batch.column(1)):
                hashes = [_shingle_hashes(t.as_py(), shingle_words) for t in texts.slice(a, b - a)]
                sizes = np.array([len(h) for h in hashes])
                every = np.concatenate(hashes)
                found = [majority_bits(every, sizes).view(np.int64)]
                for lane in range(1, lanes):
                    mixed = kernels.mix(every + np.uint64(lane) * np.uint64(kernels.BYTE_BASE))
                    found.append(majority_bits(mixed, sizes).view(np.int64))
                column = pa.array(found[0]) if lanes == 1 else pa.FixedSizeListArray.from_arrays(
                    pa.array(np.stack(found, axis=1).ravel()), lanes
                ).cast(pa.list_(pa.int64()))
                yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "fp": column})

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, fp {'bigint' if lanes == 1 else 'array<bigint>'}"
    return docs.select("doc_id", "text").mapInArrow(compute, schema)


def segment_masks(count: int) -> list[int]:
    """Bit masks of ``count`` segments, 64 bits in all."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]


def variant_masks(count: int) -> list[int]:
    """For each of the 64 bits of a lane: its segment without that bit."""
    return [mask & ~(1 << bit) for mask in segment_masks(count) for bit in range(64) if mask >> bit & 1]


class _Forest:
    """Union-find over the places of one chunk."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked_neighbours(values: np.ndarray, lengths: np.ndarray, distance: int) -> np.ndarray:
    """Places (i, j) of a spanning forest of the links within runs of ``lengths`` values;
    ``values`` has a column for each lane."""
    stop = np.repeat(np.cumsum(lengths), lengths)
    run = np.repeat(np.arange(len(lengths)), lengths)
    apart = lengths.copy()  # components left in each run
    forest, found = _Forest(len(values)), []
    at = np.flatnonzero(stop - np.arange(len(values)) > 1)
    offset = 1
    while len(at):
        near = np.bitwise_count(values[at] ^ values[at + offset]).sum(1) <= distance
        for i in at[near].tolist():
            if forest.join(i, i + offset):
                found.append((i, i + offset))
                apart[run[i]] -= 1
        offset += 1
        at = at[(at + offset < stop[at]) & (apart[run[at]] > 1)]
    return np.array(found, np.int64).reshape(-1, 2)


def links(prints: DataFrame, distance: int = DISTANCE, lanes: int = 1, segments: int | None = None) -> DataFrame:
    """``(a, b)``: links between the distinct values of column ``fp``, enough to reach
    everything that the links found reach. With ``segments`` per lane unset, those are all links
    within ``distance`` bits."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    count = segments or -(-(distance // 2 + 1) // lanes)
    parts = [F.col("fp")] if lanes == 1 else [F.col("fp")[i] for i in range(lanes)]
    variants = F.array(*[
        part.bitwiseAND(F.lit(signed(m)).cast("bigint")) for part in parts for m in variant_masks(count)
    ])
    indexed = prints.select("fp", F.posexplode(variants).alias("bit", "variant"))
    grouped = indexed.repartition("bit", "variant").sortWithinPartitions("bit", "variant", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, lanes), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            prints = batch.column(0)
            now = [(prints if lanes == 1 else prints.flatten()).to_numpy().reshape(-1, lanes)]
            now += [batch.column(i).to_numpy().astype(np.int64) for i in (1, 2)]
            fp, bit, variant = (np.concatenate(pair) for pair in zip(held, now))
            new = np.flatnonzero((bit[1:] != bit[:-1]) | (variant[1:] != variant[:-1])) + 1
            whole = new[-1] if len(new) else 0  # the last run may go on in the next batch
            held = [x[whole:] for x in (fp, bit, variant)]
            if whole:
                yield _edges(fp[:whole], np.diff(np.concatenate(([0], new))))
        if len(held[0]):
            yield _edges(held[0], np.array([len(held[0])]))

    def _edges(fp: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        many = np.repeat(lengths > 1, lengths)
        fp, lengths = fp[many], lengths[lengths > 1]
        pairs = linked_neighbours(fp.view(np.uint64), lengths, distance)
        edges = np.unique(fp[pairs].reshape(-1, 2 * lanes), axis=0)
        ends = edges[:, :lanes], edges[:, lanes:]
        if lanes == 1:
            return pa.record_batch({c: pa.array(e[:, 0]) for c, e in zip("ab", ends)})
        lists = [pa.array(list(e), pa.list_(pa.int64())) for e in ends]
        return pa.RecordBatch.from_arrays(lists, ["a", "b"])

    kind = "bigint" if lanes == 1 else "array<bigint>"
    return grouped.mapInArrow(verify, f"a {kind}, b {kind}").distinct()


def _classes(distinct: DataFrame, found: DataFrame, first: str) -> DataFrame:
    """``(fp, <first>)``: the least ``first`` among all fingerprints reachable over the links found.

    A class may hold a good part of all fingerprints: it meets its least value in ``SALTS`` parts.
    """
    reach = component_of(found).withColumnRenamed("node", "fp")
    joined = materialise(distinct.join(reach, "fp", "left"), "components")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")
    linked = joined.where("component is not null").select("fp", first, "component", salt)
    least = salted(linked.groupBy("component").agg(F.min(first).alias(first)), SALTS)
    classes = linked.drop(first).join(least, ["component", "salt"]).select("fp", first)
    return classes.unionAll(joined.where("component is null").select("fp", first))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is the smallest id reachable."""
    rows = materialise(fingerprints(docs, shingle_words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("component_id"))
    classes = _classes(distinct, links(distinct, distance), "component_id")
    # a fingerprint may be that of a third of all rows
    parts = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return parts.join(salted(classes, SALTS), ["fp", "salt"]).select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, shingle_words: int, distance: int, lanes: int = 1, segments: int | None = None
) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: that of the smallest id
    (null last), then of the smallest text hash; of rows that repeat, one."""
    # 128 bits stand for (id, text); the rows, as structs, are dealt out by them once, for both steps below
    keyed = docs.select(
        whole_row(docs).alias("row"), F.xxhash64("doc_id", text_digest(F.col("text"))).alias("key1"),
        F.xxhash64(F.lit(1), "doc_id", F.col("text"), F.col("text").isNull()).alias("key2"),
    )
    row = F.col("row")
    place = F.struct(row["doc_id"].isNull().alias("none"), row["doc_id"].alias("doc_id"), "key1", "key2")
    prints = fingerprints(keyed.select(place.alias("doc_id"), row["text"].alias("text")), shingle_words, lanes)
    rows = materialise(prints, "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("kept"))
    classes = _classes(distinct, links(distinct, distance, lanes, segments), "kept")
    kept = classes.select("kept.key1", "kept.key2").distinct()
    once = keyed.dropDuplicates(["key1", "key2"]).join(kept, ["key1", "key2"], "left_semi")
    return once.select(*[row.getField(c).alias(c) for c in docs.columns])
