"""Duplicates by normalised text: conflicts, keep-first, counts, prepared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayline.functions.text import key_digest, text_key
from assayline.schema import ID, LABEL, SENTENCE_COLUMNS, TEXT, IntegrityError

DIGEST = "_key_digest"


def with_digest(df: DataFrame) -> DataFrame:
    """Add the 32-byte digest of the text key: duplicates share it, shuffles stay narrow."""
    return df.withColumn(DIGEST, key_digest(text_key(F.col(TEXT))))


def _id_from_digest() -> Column:
    return F.concat(F.lit("sentence_"), F.lower(F.hex(DIGEST)))


def key_groups(df: DataFrame) -> DataFrame:
    """Per text key: rows and the smallest and largest label. Fixed-width, combined map-side."""
    return (
        with_digest(df)
        .groupBy(DIGEST)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(LABEL).alias("min_label"),
            F.max(LABEL).alias("max_label"),
        )
    )


def label_conflicts(df: DataFrame) -> DataFrame:
    """Stable ids of texts that carry more than one label."""
    return (
        key_groups(df)
        .where(F.col("min_label") != F.col("max_label"))
        .select(_id_from_digest().alias(ID), "rows", "min_label", "max_label")
    )


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Texts occurring more than once, and whether their labels disagree."""
    return (
        key_groups(df)
        .where(F.col("rows") > 1)
        .select(
            _id_from_digest().alias(ID),
            "rows",
            (F.col("min_label") != F.col("max_label")).alias("conflict"),
        )
    )


def dedup_keep_first(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each text key by ``order``, original text kept.

    The rank filter lets Spark keep one row per key in every map task before the shuffle
    (``WindowGroupLimit``), so a key holding a third of the rows sends one row per task.
    """
    first = W.partitionBy(DIGEST).orderBy(*order)
    return (
        with_digest(df)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def dedup_counts(df: DataFrame) -> DataFrame:
    return key_groups(df).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("prepared_rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("removed"),
    )


def require_counts(
    df: DataFrame, raw_rows: int | None = None, prepared_rows: int | None = None
) -> None:
    row = dedup_counts(df).first()
    for name, expected in (("raw_rows", raw_rows), ("prepared_rows", prepared_rows)):
        if expected is not None and row[name] != expected:
            raise IntegrityError(
                f"unexpected {name}: expected {expected}, observed {row[name]} "
                f"({row['removed']} duplicates)"
            )


def prepare(df: DataFrame, order: list[str]) -> DataFrame:
    """Deduplicated table ``(sentence_id, source, text, label)`` with content-derived ids."""
    return dedup_keep_first(df, order).select(
        _id_from_digest().alias(ID),
        "source",
        TEXT,
        F.col(LABEL).cast("bigint").alias(LABEL),
    )


def prepare_checked(
    df: DataFrame,
    order: list[str],
    raw_rows: int | None = None,
    prepared_rows: int | None = None,
    may_conflict: bool = False,
) -> DataFrame:
    """``prepare`` that first fails on conflicting labels and unexpected counts. With ``may_conflict`` the
    first of equal texts stands, label and all; the caller reports ``label_conflicts``."""
    conflict = [] if may_conflict else label_conflicts(df).head(1)
    if conflict:
        raise IntegrityError(f"duplicate texts with conflicting labels, e.g. {conflict[0][ID]}")
    if raw_rows is not None or prepared_rows is not None:
        require_counts(df, raw_rows, prepared_rows)
    prepared = prepare(df, order)
    assert tuple(prepared.columns) == SENTENCE_COLUMNS
    return prepared
