"""Exact, order-independent stratified splits, their application and the leakage audit."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayline.functions.text import key_digest, text_key
from assayline.operators.quality import (
    one_to_one_violations,
    require_clean,
    validate_assignments,
    validate_contract,
)
from assayline.schema import (
    ID,
    LABEL,
    SOURCE,
    SPLIT,
    SPLIT_NAMES,
    TEXT,
    SplitError,
)
from assayline.session import checked_broadcast, materialise

_STRATUM = [SOURCE, LABEL]


@dataclass(frozen=True)
class SplitConfig:
    """Shares of all rows that go to test and to validation; train has the rest."""

    test_size: float = 0.20
    validation_size: float = 0.20
    seed: int = 42


_HASH, _BUCKET = "_hash", "_bucket"


def small_strata(df: DataFrame, least: int = len(SPLIT_NAMES)) -> DataFrame:
    """(source, label) strata with too few rows to reach every split."""
    return df.groupBy(*_STRATUM).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < least)


def stratum_quotas(sizes: DataFrame, config: SplitConfig) -> DataFrame:
    """Rows per stratum going to test and to validation, by largest remainder.

    ``sizes`` has one row per stratum. The overall sizes are exact: the test split gets the
    rounded-up share of all rows, validation the rounded-up share of what is left.
    """
    held_back, kept = config.test_size, 1 - config.test_size
    if not (0 < held_back < 1 and 0 < config.validation_size < kept):
        raise SplitError(f"no share of the rows may be empty: {config}")
    relative = config.validation_size / kept
    whole = W.partitionBy(F.lit(0))

    def apportion(frame: DataFrame, pool: str, share: float, out: str) -> DataFrame:
        total = F.sum(pool).over(whole)
        target = F.ceil(F.lit(share) * total)
        exact = F.col(pool) * target / total
        ranked = frame.withColumns({"_target": target, "_exact": exact}).withColumn(
            "_floor", F.floor("_exact")
        )
        spare = F.col("_target") - F.sum("_floor").over(whole)
        place = F.row_number().over(
            whole.orderBy((F.col("_exact") - F.col("_floor")).desc(), *_STRATUM)
        )
        return ranked.withColumn(
            out, F.col("_floor") + (place <= spare).cast("bigint")
        ).drop("_target", "_exact", "_floor")

    quotas = apportion(sizes, "n", held_back, "test_quota")
    quotas = quotas.withColumn("_rest", F.col("n") - F.col("test_quota"))
    return apportion(quotas, "_rest", relative, "validation_quota").drop("_rest")


def _same_stratum(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Join on source and label, null meeting null."""
    renamed = strata.withColumnsRenamed({c: f"_{c}" for c in _STRATUM})
    same = F.lit(True)
    for c in _STRATUM:
        same &= rows[c].eqNullSafe(renamed[f"_{c}"])
    return rows.join(renamed, same).drop(*[f"_{c}" for c in _STRATUM])


def stratified_split(
    df: DataFrame, config: SplitConfig | None = None, hash_digits: int = 4
) -> DataFrame:
    """``(sentence_id, split)`` with exact stratified sizes, whatever the row order.

    A null source or label is a stratum value like any other, so every row is assigned.

    Inside a stratum rows are ranked by the SHA-256 of seed and id; the lowest ranks form
    the test split, the next ones validation. No stratum is ever sorted as a whole: rows
    fall into buckets by the leading hash digits, bucket counts say which buckets lie
    wholly inside one split, and only the (at most two) buckets per stratum that a boundary
    cuts are ranked. Everything else is decided row by row against a table of one row per
    stratum, so a stratum holding a third of the data stays spread over all tasks.
    """
    config = config or SplitConfig()
    hashed = F.sha2(F.concat(F.lit(f"{config.seed}|"), F.col(ID)), 256)
    rows = df.select(ID, *_STRATUM, hashed.alias(_HASH)).withColumn(
        _BUCKET, F.conv(F.substring(_HASH, 1, hash_digits), 16, 10).cast("int")
    )
    buckets = rows.groupBy(*_STRATUM, _BUCKET).agg(F.count(F.lit(1)).alias("rows"))
    sizes = buckets.groupBy(*_STRATUM).agg(F.sum("rows").alias("n"))
    quotas = stratum_quotas(sizes, config)

    upto = W.partitionBy(*_STRATUM).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    filled = buckets.withColumn("_before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    placed = _same_stratum(filled, quotas)
    first_end = F.col("test_quota")
    second_end = F.col("test_quota") + F.col("validation_quota")

    def cut(end: Column, out: str) -> list[Column]:
        """The bucket the boundary falls into, with the rows ahead of it."""
        inside = (F.col("_before") < end) & (end <= F.col("_before") + F.col("rows"))
        return [
            F.max(F.when(inside, F.col(_BUCKET))).alias(f"{out}_bucket"),
            F.max(F.when(inside, F.col("_before"))).alias(f"{out}_before"),
        ]

    bounds = placed.groupBy(*_STRATUM).agg(
        F.max(first_end).alias("first_end"),
        F.max(second_end).alias("second_end"),
        *cut(first_end, "first"),
        *cut(second_end, "second"),
    )
    # An end of zero rows lies before every bucket.
    bounds = bounds.select(
        *_STRATUM,
        "first_end",
        "second_end",
        F.coalesce("first_bucket", F.lit(-1)).alias("first_bucket"),
        F.coalesce("second_bucket", F.lit(-1)).alias("second_bucket"),
        "first_before",
        "second_before",
    )
    located = _same_stratum(rows, checked_broadcast(bounds))
    bucket = F.col(_BUCKET)
    on_cut = (bucket == F.col("first_bucket")) | (bucket == F.col("second_bucket"))
    clear = located.where(~on_cut).select(
        ID,
        F.when(bucket < F.col("first_bucket"), "test")
        .when(bucket < F.col("second_bucket"), "validation")
        .otherwise("train")
        .alias(SPLIT),
    )
    in_bucket = W.partitionBy(*_STRATUM, _BUCKET).orderBy(_HASH, ID)
    before = F.when(bucket == F.col("first_bucket"), F.col("first_before")).otherwise(
        F.col("second_before")
    )
    ranked = located.where(on_cut).withColumn("_rank", before + F.row_number().over(in_bucket))
    contested = ranked.select(
        ID,
        F.when(F.col("_rank") <= F.col("first_end"), "test")
        .when(F.col("_rank") <= F.col("second_end"), "validation")
        .otherwise("train")
        .alias(SPLIT),
    )
    return clear.unionByName(contested)


def apply_split(df: DataFrame, assignments: DataFrame, check: bool = True) -> DataFrame:
    """``df`` with its split; both sides must hold each id once."""
    if check:
        require_clean(one_to_one_violations(df, assignments), SplitError)
    return df.join(assignments, ID, "left").select(*df.columns, SPLIT)


_PAIRS = list(combinations(range(len(SPLIT_NAMES)), 2))


def leakage_audit(assigned: DataFrame) -> DataFrame:
    """Ids and text keys shared by each pair of splits: six rows ``(kind, left, right, shared)``.

    Each id and key collects the splits it occurs in as a bit mask, combined map-side.
    """
    bit = F.lit(0)
    for index, name in enumerate(SPLIT_NAMES):
        bit = F.when(F.col(SPLIT) == name, F.lit(1 << index)).otherwise(bit)
    keyed = assigned.select(ID, bit.alias("bit"), text_key(F.col(TEXT)).alias("_key"))
    facts = keyed.select(
        "bit",
        F.inline(
            F.array(
                F.struct(F.lit("id").alias("kind"), F.col(ID).cast("binary").alias("value")),
                F.struct(F.lit("text").alias("kind"), key_digest(F.col("_key")).alias("value")),
            )
        ),
    )
    masks = facts.groupBy("kind", "value").agg(F.bit_or("bit").alias("mask"))
    entries = F.array(
        *[
            F.struct(
                F.lit(SPLIT_NAMES[a]).alias("left_split"),
                F.lit(SPLIT_NAMES[b]).alias("right_split"),
                F.col(f"shared_{a}_{b}").alias("shared"),
            )
            for a, b in _PAIRS
        ]
    )
    shared = [
        F.count_if(
            F.col("mask").bitwiseAND(F.lit((1 << a) | (1 << b))) == ((1 << a) | (1 << b))
        ).alias(f"shared_{a}_{b}")
        for a, b in _PAIRS
    ]
    return masks.groupBy("kind").agg(*shared).select("kind", F.inline(entries))


def require_no_leakage(assigned: DataFrame) -> None:
    leak = leakage_audit(assigned).where(F.col("shared") > 0).head(1)
    if leak:
        row = leak[0]
        raise SplitError(
            f"{row['shared']} {row['kind']} values shared by "
            f"{row['left_split']} and {row['right_split']}"
        )


def create_splits(
    df: DataFrame, config: SplitConfig | None = None, sources: list[str] | None = None
) -> DataFrame:
    """Validated, split and audited table; fails closed like every check it uses."""
    require_clean(validate_contract(df, sources))
    if small_strata(df).head(1):
        raise SplitError("every (source, label) stratum needs at least three rows")
    # written once: everything below reads the same assignment and repeats no split
    assignments = materialise(stratified_split(df, config), "assignments")
    require_clean(validate_assignments(assignments, df), SplitError)
    assigned = apply_split(df, assignments, check=False)
    # the table as a whole keeps the contract, so a part can break it only by lacking a label
    # of a source: one pass over all parts
    parts = assigned.groupBy(SPLIT, SOURCE).agg(F.min(LABEL).alias("low"), F.max(LABEL).alias("high"))
    full = parts.agg(F.count_if(F.col("low") < F.col("high")), F.count_distinct(SOURCE)).first()
    if full[0] < len(SPLIT_NAMES) * full[1]:
        raise SplitError("every split needs both labels of every source")
    require_no_leakage(assigned)
    return assigned
