"""Line deduplication by range-partitioned line hashes.

Hashes of all lines are range-partitioned and, inside a partition, sorted by hash, document and
position, so that the first document of a hash is met first. A hash is divided further by a
salt of the document: its rows then lie in ``SALTS`` runs, which range partitioning may put into
as many tasks, and a second pass over the first documents of the runs (at most one document per
run) finds the first of all. A line that every third document holds therefore never meets in
one task, and nothing is joined on a line.

The result is a bitmap per document and not a text: words of 64 lines, of which only those with
a dropped line are stored.

Rows: a document is a distinct (doc_id, text). Rows that repeat both get the same bitmap; rows
that share only the id count as one document when copies are looked for. A null id sorts last
and counts as one document. Null text is an empty one: one empty line. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.columns import SPACES, ascii_lower, let, same_row, text_digest
from assayline.session import materialise

MIN_CODE_POINTS = 10
SALTS = 64
_ROW = ["doc_id", "digest"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``(doc_id, digest, position, h1, h2, salt)`` of every line whose key is long enough.

    The key is the line without white space at its ends and with A-Z lower-cased; 128 bits of
    hash stand for it.
    """
    split = docs.select(
        "doc_id", text_digest(F.col("text")).alias("digest"),
        F.posexplode(_lines(F.col("text"))).alias("position", "line"),
    )
    keyed = split.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACES))))
    return keyed.where(F.char_length("key") >= min_code_points).select(
        *_ROW, "position",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def dropped_lines(hashes: DataFrame) -> DataFrame:
    """``(doc_id, digest, position)`` of the lines that an earlier document holds too."""
    runs = W.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").asc_nulls_last())
    whole = W.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last())
    ranged = hashes.repartitionByRange("h1", "h2", "salt").sortWithinPartitions(
        "h1", "h2", "salt", F.col("doc_id").asc_nulls_last(), "position"
    )
    ranked = ranged.withColumn("place", F.rank().over(runs))  # streams in that order, sorted once
    in_run = ranked.where("place > 1")
    firsts = ranked.where("place = 1").withColumn("place", F.rank().over(whole))
    return in_run.select(*_ROW, "position").unionAll(
        firsts.where("place > 1").select(*_ROW, "position")
    )


def keep_bitmaps(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``(doc_id, digest, n_dropped, dropped)`` of each document that loses a line.

    ``dropped`` maps a word number to 64 bits: bit b of word w is set if line 64w + b goes.
    Words without a set bit are left out.
    """
    dropped = dropped_lines(materialise(line_hashes(docs, min_code_points), "line-hashes"))
    words = dropped.groupBy(*_ROW, (F.col("position") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, position % 64))").alias("bits")
    )
    return words.groupBy(*_ROW).agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
    )


def _kept(lines: Column, dropped: Column) -> Column:
    last_word = F.floor((F.size(lines) - 1) / 64).cast("int")
    dense = let(dropped, lambda words: F.transform(
        F.sequence(F.lit(0), last_word), lambda w: F.coalesce(words[w], F.lit(0).cast("long"))
    ))
    return let(F.struct(lines.alias("lines"), dense.alias("mask")), lambda row: F.filter(
        row["lines"],
        lambda _, at: F.getbit(F.get(row["mask"], F.floor(at / 64).cast("int")), at % 64) == 0,
    ))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay.

    Columns of ``docs`` with these names or named ``digest`` or ``dropped`` are replaced.
    """
    rows = docs.drop("n_lines", "n_dropped", "kept", "digest", "dropped")
    left = rows.withColumn("digest", text_digest(F.col("text"))).alias("l")
    right = bitmaps.alias("r")
    joined = left.join(right, same_row("l", "r", _ROW), "left")
    text = F.coalesce(F.col("l.text"), F.lit(""))
    lines = _lines(F.col("l.text"))
    return joined.select(
        *[F.col(f"l.`{name}`") for name in rows.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.col("r.n_dropped"), F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("r.dropped").isNull(), text)
        .otherwise(F.array_join(_kept(lines, F.col("r.dropped")), "\n")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the ``kept`` text of each row."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_code_points))
