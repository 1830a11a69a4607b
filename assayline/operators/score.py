"""Batch scoring: input checks, default ids, model, output without text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assayline.functions.probability import is_bad_probability, predicted_label, sentiment
from assayline.functions.text import is_blank
from assayline.operators.learn import FAMILIES, Rung, VectorModel, load_rung
from assayline.operators.quality import _as_rows
from assayline.schema import DECISION_THRESHOLD, ID, TEXT
from assayline.sources.positions import with_scan_position
from assayline.sources.tables import CSV_OPTIONS, publish, scan_scoring_input

OUTPUT_COLUMNS = (ID, "positive_probability", "predicted_label", "predicted_sentiment", "model")


def with_default_ids(scan: DataFrame) -> DataFrame:
    """Number the rows of a file read ``input_000000`` onwards when they carry no id."""
    if ID in scan.columns:
        return scan
    placed = with_scan_position(scan, "_at", per_file=False)
    name = F.format_string("input_%06d", F.col("_at"))
    return placed.select(name.alias(ID), *scan.columns)


def scoring_violations(df: DataFrame) -> DataFrame:
    """Rules of scoring input: some rows, no blank text, ids present and unique."""
    if TEXT not in df.columns:
        raise ValueError(f"scoring input has no column {TEXT!r}")
    bad_text = F.col(TEXT).isNull() | is_blank(F.col(TEXT))
    per_id = df.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad_text).alias("bad_text")
    )
    named = F.col(ID).isNotNull()
    totals = per_id.agg(
        F.sum("n").alias("rows"),
        F.sum("bad_text").alias("bad_text"),
        F.sum(F.when(~named, F.col("n"))).alias("null_ids"),
        F.count_if(named & (F.col("n") > 1)).alias("repeated"),
    )
    return _as_rows(
        totals,
        [
            ("non_empty", F.coalesce(F.col("rows"), F.lit(0)).eqNullSafe(0).cast("bigint")),
            ("text_present", F.col("bad_text")),
            ("id_present", F.col("null_ids")),
            ("id_unique", F.col("repeated")),
        ],
    )


def require_scoring_input(df: DataFrame) -> None:
    bad = scoring_violations(df).where(F.col("violations") > 0).orderBy("rule_order").head(1)
    if bad:
        raise ValueError(f"scoring input: {bad[0]['rule']}, {bad[0]['violations']} violations")


def decide(
    scored: DataFrame, model: str, threshold: float = DECISION_THRESHOLD, carried: tuple[str, ...] = ()
) -> DataFrame:
    """The output table; an unusable probability fails the job instead of being written.
    ``carried`` columns of the scored rows come behind it."""
    p = F.col("probability")
    safe = F.when(
        is_bad_probability(p), F.raise_error(F.lit("model returned an invalid probability"))
    ).otherwise(p)
    label = predicted_label(F.col("positive_probability"), threshold)
    return scored.select(ID, safe.alias("positive_probability"), *carried).select(
        ID,
        "positive_probability",
        label.alias("predicted_label"),
        sentiment(label).alias("predicted_sentiment"),
        F.lit(model).alias("model"),
        *carried,
    )


def score_batch(df: DataFrame, rung: Rung, check: bool = True) -> DataFrame:
    """Score text rows with a fitted rung; nothing but ids and decisions comes out."""
    if rung.name not in FAMILIES:
        raise ValueError(f"unknown model {rung.name!r}; choose one of {sorted(FAMILIES)}")
    rows = with_default_ids(df)
    if check:
        require_scoring_input(rows)
    return decide(rung.score(rows), rung.name)


_BAD_TEXT = "_bad_text"


def score_file(
    spark: SparkSession,
    source: str,
    target: str,
    model_path: str,
    model: str,
    fmt: str = "csv",
    replace: bool = True,
) -> str:
    """Score the rows of a file into a table at ``target`` with any saved rung; returns ``target``.

    Rows without an id column are numbered in file order first. The texts are scored and checked
    in one pass: no rows at all, blank texts and missing ids are counted by the tasks that write the
    scores (a task that is run again may count twice, so counts are only compared with zero).
    Given ids are then compared over the written scores alone. Any violation or unusable
    probability leaves ``target`` as it was and nothing beside it.
    """
    if model not in FAMILIES:
        raise ValueError(f"unknown model {model!r}; choose one of {sorted(FAMILIES)}")
    rung = load_rung(model_path, model, spark)
    vectors = (rung.model.column,) if isinstance(rung.model, VectorModel) else ()
    scan = scan_scoring_input(spark, source, fmt, vectors)
    given_ids = ID in scan.columns
    text = F.coalesce(F.col(TEXT), F.lit(""))
    rows = with_default_ids(scan).select(ID, text.alias(TEXT), *vectors, is_blank(text).alias(_BAD_TEXT))
    seen = Observation()
    decided = decide(rung.score(rows), rung.name, carried=(_BAD_TEXT,)).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_BAD_TEXT).alias("text_present"),
        F.count_if(F.col(ID).isNull()).alias("id_present"),
    )

    def check(written: str) -> None:
        found = seen.get
        if not found["rows"]:
            raise ValueError("scoring input: non_empty, no rows")
        for rule in ("text_present", "id_present"):
            if found[rule]:
                raise ValueError(f"scoring input: {rule}, violated")
        if given_ids:
            ids = read_scores(spark, written, fmt).groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
            repeated = ids.where("n > 1").head(1)
            if repeated:
                raise ValueError(f"scoring input: id_unique, {repeated[0][ID]!r} repeats")

    return publish(decided.select(*OUTPUT_COLUMNS), target, fmt, replace, check)


SCORES = (
    f"{ID} string, positive_probability double, predicted_label int, predicted_sentiment string, "
    "model string"
)


def read_scores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A table that ``score_file`` published."""
    reader = spark.read.options(**CSV_OPTIONS) if fmt == "csv" else spark.read
    return reader.schema(SCORES).format(fmt).load(path)


def score_with(
    df: DataFrame, name: str, load: Callable[[], Callable[[pd.Series], pd.Series]]
) -> DataFrame:
    """Score with any Python model: ``load`` runs once per task, then sees Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield pd.DataFrame({ID: batch[ID], "probability": predict(batch[TEXT])})

    scored = df.select(ID, TEXT).mapInPandas(run, f"{ID} string, probability double")
    return decide(scored, name)
