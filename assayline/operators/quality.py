"""Contract checks. Each returns ``(rule_order, rule, violations)``; ``require_clean`` raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.probability import is_bad_probability
from assayline.functions.text import is_blank, key_digest, text_key
from assayline.schema import (
    ASSIGNMENT_COLUMNS,
    ID,
    LABEL,
    SENTENCE_COLUMNS,
    SOURCE,
    SPLIT,
    SPLIT_NAMES,
    TEXT,
    IntegrityError,
)

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _as_rows(totals: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per rule out of a one-row frame of totals."""
    entries = [
        F.struct(
            F.lit(order).alias("rule_order"),
            F.lit(name).alias("rule"),
            F.coalesce(count.cast("bigint"), F.lit(0)).alias("violations"),
        )
        for order, (name, count) in enumerate(rules, start=1)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def require_clean(violations: DataFrame, error: type[Exception] = IntegrityError) -> None:
    """Raise on the first broken rule; the frame has one row per rule, so this is small."""
    bad = violations.where(F.col("violations") > 0).orderBy("rule_order").head(1)
    if bad:
        raise error(f"{bad[0]['rule']}: {bad[0]['violations']} violations")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def _wrong_columns(df: DataFrame, expected: tuple[str, ...]) -> DataFrame | None:
    if tuple(df.columns) == expected:
        return None
    return df.sparkSession.range(1).select(
        F.lit(1).alias("rule_order"),
        F.lit("columns").alias("rule"),
        F.lit(1).cast("bigint").alias("violations"),
    )


def validate_contract(
    df: DataFrame, sources: list[str] | None = None, covered: bool = True
) -> DataFrame:
    """The eleven rules of a prepared table, in one scan and one shuffle.

    Every row is dealt out as three facts - its source, its id and its text key - and the
    facts are counted together, so the per-source sums and both uniqueness checks share the
    exchange. Counting combines on the map side: a hot source, id or key costs nothing.
    Without ``covered`` a source may be absent or have one label; an unknown one is still a violation.
    """
    wrong = _wrong_columns(df, SENTENCE_COLUMNS)
    if wrong is not None:
        return wrong
    integer = isinstance(df.schema[LABEL].dataType, _INTEGERS)
    label = F.col(LABEL)
    measures = {
        "nulls": sum((_flag(F.col(c).isNull()) for c in SENTENCE_COLUMNS), F.lit(0)),
        "blank_id": _flag(is_blank(F.col(ID))),
        "blank_text": _flag(is_blank(F.col(TEXT))),
        "bad_label": _flag(~label.isin(0, 1)),
        "negatives": _flag(label == 0),
        "positives": _flag(label == 1),
        "empty_key": _flag(F.col("_key") == ""),
    }
    keyed = df.withColumn("_key", text_key(F.col(TEXT)))
    zero = [F.lit(0).cast("bigint").alias(name) for name in measures]
    facts = keyed.select(
        F.array(
            F.struct(
                F.lit("source").alias("kind"),
                F.col(SOURCE).cast("binary").alias("value"),
                *[m.cast("bigint").alias(name) for name, m in measures.items()],
            ),
            F.struct(F.lit("id").alias("kind"), F.col(ID).cast("binary").alias("value"), *zero),
            F.struct(
                F.lit("key").alias("kind"), key_digest(F.col("_key")).alias("value"), *zero
            ),
        ).alias("facts")
    ).select(F.inline("facts"))
    counted = facts.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in measures]
    )
    is_source = F.col("kind") == "source"
    repeated = F.col("value").isNotNull() & (F.col("n") > 1)
    known = F.col("value").cast("string").isin(list(sources)) if sources else F.lit(True)
    totals = counted.agg(
        F.sum(F.when(is_source, F.col("n"))).alias("rows"),
        *[F.sum(name).alias(name) for name in measures],
        F.count_if((F.col("kind") == "id") & repeated).alias("repeated_ids"),
        F.count_if((F.col("kind") == "key") & repeated).alias("repeated_keys"),
        F.count_if(is_source & ~known).alias("unknown_sources"),
        F.count_if(is_source & known & F.col("value").isNotNull()).alias("known_sources"),
        F.count_if(is_source & ((F.col("negatives") == 0) | (F.col("positives") == 0))).alias(
            "one_sided_sources"
        ),
    )
    missing = F.lit(len(set(sources))) - F.col("known_sources") if sources and covered else F.lit(0)
    absent = lambda name: _flag(F.coalesce(F.col(name), F.lit(0)) == 0)
    return _as_rows(
        totals,
        [
            ("columns", F.lit(0)),
            ("non_empty", absent("rows")),
            ("no_nulls", F.col("nulls")),
            ("id_not_blank", F.col("blank_id")),
            ("id_unique", F.col("repeated_ids")),
            ("text_not_blank", F.col("blank_text")),
            ("label_integer", F.lit(0 if integer else 1)),
            ("label_binary", F.col("bad_label") + absent("negatives") + absent("positives")),
            ("source_set", F.col("unknown_sources") + missing),
            ("source_has_both_labels", F.col("one_sided_sources") if covered else F.lit(0)),
            ("key_unique", F.col("empty_key") + F.col("repeated_keys")),
        ],
    )


def _id_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per id, how often it occurs left and right; one shuffle with map-side counts."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(F.col(key), one.alias("l"), none.alias("r")).unionByName(
        right.select(F.col(key), none.alias("l"), one.alias("r"))
    )
    return both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def id_reconcile(expected: DataFrame, observed: DataFrame, key: str = ID) -> DataFrame:
    """One row: ids missing from ``observed``, extra in it, and shared."""
    sides = _id_sides(expected, observed, key)
    return sides.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("missing"),
        F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("extra"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("shared"),
    )


def one_to_one_violations(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    sides = _id_sides(left, right, key)
    return _as_rows(
        sides.agg(
            F.count_if(F.col("l") > 1).alias("left"), F.count_if(F.col("r") > 1).alias("right")
        ),
        [("left_keys_unique", F.col("left")), ("right_keys_unique", F.col("right"))],
    )


def validate_assignments(assignments: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rules of an assignment table; with ``expected``, its ids must match that frame's."""
    wrong = _wrong_columns(assignments, ASSIGNMENT_COLUMNS)
    if wrong is not None:
        return wrong
    known = F.col(SPLIT).isin(*SPLIT_NAMES)
    measures = {
        "observed": F.lit(1),
        "nulls": _flag(F.col(ID).isNull()) + _flag(F.col(SPLIT).isNull()),
        "blank": _flag(is_blank(F.col(ID))),
        "unknown": _flag(~known),
        **{name: _flag(F.col(SPLIT) == name) for name in SPLIT_NAMES},
    }
    facts = assignments.select(
        ID,
        F.lit(0).cast("bigint").alias("expected"),
        *[m.cast("bigint").alias(name) for name, m in measures.items()],
    )
    if expected is not None:
        facts = facts.unionByName(
            expected.select(
                ID,
                F.lit(1).cast("bigint").alias("expected"),
                *[F.lit(0).cast("bigint").alias(name) for name in measures],
            )
        )
    names = ["expected", *measures]
    per_id = facts.groupBy(ID).agg(*[F.sum(name).alias(name) for name in names])
    has_id = F.col(ID).isNotNull()
    totals = per_id.agg(
        *[F.sum(name).alias(name) for name in names],
        F.count_if(has_id & (F.col("observed") > 1)).alias("repeated"),
        F.count_if((F.col("expected") > 0) & (F.col("observed") == 0)).alias("missing"),
        F.count_if(has_id & (F.col("expected") == 0) & (F.col("observed") > 0)).alias("extra"),
    )
    absent = sum(
        (_flag(F.coalesce(F.col(name), F.lit(0)) == 0) for name in SPLIT_NAMES), F.lit(0)
    )
    against = F.lit(0 if expected is None else 1)
    return _as_rows(
        totals,
        [
            ("columns", F.lit(0)),
            ("non_empty", _flag(F.coalesce(F.col("observed"), F.lit(0)) == 0)),
            ("no_nulls", F.col("nulls")),
            ("id_not_blank", F.col("blank")),
            ("id_unique", F.col("repeated")),
            ("split_set", F.coalesce(F.col("unknown"), F.lit(0)) + absent),
            ("ids_missing", F.col("missing") * against),
            ("ids_extra", F.col("extra") * against),
        ],
    )


def validate_splits(df: DataFrame, require_test_labels: bool = False) -> DataFrame:
    """Training rules per split of a frame with ``split``, ``text`` and ``label``.

    Rows ``(split, rows, bad_text, bad_label, missing_class)``; a split that is absent has
    ``rows`` 0. Test labels are looked at only on request.
    """
    labelled = F.lit(require_test_labels) | (F.col(SPLIT) != "test")
    label = F.col(LABEL)
    counts = df.groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(TEXT).isNull() | is_blank(F.col(TEXT))).alias("bad_text"),
        F.count_if(labelled & (label.isNull() | ~label.isin(0, 1))).alias("bad_label"),
        F.count_if(label == 0).alias("negatives"),
        F.count_if(label == 1).alias("positives"),
    )
    names = df.sparkSession.createDataFrame([(name,) for name in SPLIT_NAMES], f"{SPLIT} string")
    one_sided = _flag(F.col("negatives") == 0) + _flag(F.col("positives") == 0)
    return names.join(counts, SPLIT, "left").select(
        SPLIT,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "bad_text", "bad_label")],
        F.when(F.col(SPLIT) == "train", F.coalesce(one_sided, F.lit(2)))
        .otherwise(F.lit(0))
        .alias("missing_class"),
    )


def require_splits(checked: DataFrame) -> None:
    for row in checked.collect():  # three rows
        problems = [n for n in ("bad_text", "bad_label", "missing_class") if row[n]]
        if not row["rows"]:
            problems.append("no rows")
        if problems:
            raise ValueError(f"{row[SPLIT]} split: {', '.join(problems)}")


def class_coverage(df: DataFrame) -> DataFrame:
    """Per source: rows of either label and whether both occur."""
    counts = df.groupBy(SOURCE).agg(
        F.count_if(F.col(LABEL) == 0).alias("negatives"),
        F.count_if(F.col(LABEL) == 1).alias("positives"),
    )
    both = (F.col("negatives") > 0) & (F.col("positives") > 0)
    return counts.withColumn("has_both", both)


def probability_sanity(df: DataFrame, by: list[str], probability: str = "probability") -> DataFrame:
    """Per group: rows, null/NaN/out-of-range probabilities, and missing classes."""
    label = F.col(LABEL)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_bad_probability(F.col(probability))).alias("bad_probabilities"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("bad_labels"),
        (F.lit(2) - _flag(F.max(_flag(label == 0)) == 1) - _flag(F.max(_flag(label == 1)) == 1))
        .cast("bigint")
        .alias("missing_classes"),
    )


def require_sane(df: DataFrame, by: list[str], probability: str = "probability") -> None:
    bad = ["bad_probabilities", "bad_labels", "missing_classes"]
    checked = probability_sanity(df, by, probability)
    row = checked.where(sum((F.col(c) for c in bad), F.lit(0)) > 0).head(1)
    if row:
        raise IntegrityError(f"unusable probabilities or labels: {row[0].asDict()}")
