"""Comparing models: alignment, wide predictions, selection, slices, cost, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayline.functions.probability import predicted_label
from assayline.operators.metrics import METRIC_NAMES, probability_metrics
from assayline.operators.uncertainty import bootstrap_interval
from assayline.schema import DECISION_THRESHOLD, ID, LABEL, SOURCE, SPLIT, IntegrityError

# Codes of the three rungs, their printed names, and the cost-ratio floors.
BASELINE = "tfidf_logistic_regression"
DISPLAY_NAMES = {
    "tfidf_logistic_regression": "TF-IDF + Logistic Regression",
    "embedding_network": "Word embeddings + network",
    "pretrained_vectors": "Pretrained vectors + Logistic Regression",
}
SECONDS_FLOOR = 1e-9
COUNT_FLOOR = 1


def prediction_alignment(predictions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per model and split: rows missing, extra or repeated against the split's ids.

    Every model is held against every split, also one it has no prediction for. Ids are not
    paired with models: they are summed per (split, id, model) and per split, and only the names
    of models and splits, a few each, are combined.
    """
    models = predictions.select("model", SPLIT).groupBy("model", SPLIT).agg(
        F.count(F.lit(1)).alias("predicted")
    )
    sizes = assigned.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("expected"))
    named = models.groupBy(F.lit(1).alias("_one")).agg(F.collect_set("model").alias("_models"))
    seen = models.select(SPLIT).distinct().join(sizes, SPLIT, "full_outer")
    wanted = seen.withColumn("_one", F.lit(1)).join(named, "_one").select(
        F.explode("_models").alias("model"), SPLIT, "expected"
    )
    per_id = predictions.groupBy("model", SPLIT, ID).agg(F.count(F.lit(1)).alias("n"))
    known = assigned.select(SPLIT, ID, F.lit(True).alias("_known"))
    matched = (
        per_id.join(known, [SPLIT, ID], "left")
        .groupBy("model", SPLIT)
        .agg(
            F.count_if(F.col("_known")).alias("_hits"),
            F.count_if(F.col("_known").isNull()).alias("extra"),
            F.count_if(F.col("n") > 1).alias("repeated"),
        )
    )
    none = F.lit(0).cast("bigint")
    return (
        wanted.join(models, ["model", SPLIT], "left")
        .join(matched, ["model", SPLIT], "left")
        .select(
            "model",
            SPLIT,
            F.coalesce("predicted", none).alias("predicted"),
            (F.coalesce("expected", none) - F.coalesce("_hits", none)).alias("missing"),
            F.coalesce("extra", none).alias("extra"),
            F.coalesce("repeated", none).alias("repeated"),
        )
        .where("predicted + missing > 0")
    )


def require_aligned(predictions: DataFrame, assigned: DataFrame) -> None:
    off = F.col("missing") + F.col("extra") + F.col("repeated")
    bad = prediction_alignment(predictions, assigned).where(off > 0).head(1)
    if bad:
        raise IntegrityError(f"predictions are not aligned to the split: {bad[0].asDict()}")


def wide_predictions(
    labelled: DataFrame, models: list[str], threshold: float = DECISION_THRESHOLD
) -> DataFrame:
    """One row per item with a probability and a prediction column per model.

    ``labelled`` is long: ``(id, source, label, model, probability)``. Conditional maxima
    need one shuffle by item with map-side combine.
    """
    picked = [
        F.max(F.when(F.col("model") == name, F.col("probability"))).alias(f"{name}_probability")
        for name in models
    ]
    wide = labelled.groupBy(ID, SOURCE, LABEL).agg(*picked)
    return wide.select(
        ID,
        SOURCE,
        LABEL,
        *[
            column
            for name in models
            for column in (
                F.col(f"`{name}_probability`"),
                predicted_label(F.col(f"`{name}_probability`"), threshold).alias(
                    f"{name}_prediction"
                ),
            )
        ],
    )


def disagreements(wide: DataFrame, models: list[str]) -> DataFrame:
    """Items on which the models' predictions are not all equal."""
    predictions = [F.col(f"`{name}_prediction`") for name in models]
    return wide.where(F.least(*predictions) != F.greatest(*predictions))


def milliseconds_per_sample(seconds: Column, samples: Column) -> Column:
    return F.when(samples <= 0, F.lit(0.0)).otherwise(F.lit(1000.0) * seconds / samples)


def with_cost_columns(runs: DataFrame) -> DataFrame:
    return runs.withColumn(
        "inference_ms_per_sample",
        milliseconds_per_sample(F.col("inference_seconds"), F.col("inference_samples")),
    ).withColumn("artifact_mib", F.col("artifact_bytes") / F.lit(float(1024**2)))


def cost_ratios(costs: DataFrame, baseline: str, scope: list[str] | None = None) -> DataFrame:
    """Time, latency, parameters and bytes of each model over the baseline's.

    The baseline's numbers are looked up by a window over the model rows of each scope.
    """
    group = W.partitionBy(*(scope or [F.lit(0)]))
    of_baseline = lambda c: F.max(F.when(F.col("model") == baseline, F.col(c))).over(group)

    def ratio(column: str, floor: float) -> Column:
        return (F.col(column) / F.greatest(of_baseline(column), F.lit(floor))).alias(
            f"{column}_ratio"
        )

    return costs.select(
        *(scope or []),
        "model",
        ratio("train_seconds", SECONDS_FLOOR),
        ratio("inference_ms_per_sample", SECONDS_FLOOR),
        ratio("parameter_count", COUNT_FLOOR),
        ratio("artifact_bytes", COUNT_FLOOR),
    )


def display_name(model: Column) -> Column:
    name = model
    for code, label in DISPLAY_NAMES.items():
        name = F.when(model == code, F.lit(label)).otherwise(name)
    return name


def split_metrics(
    scored: DataFrame, edges: list[float] | None = None, by: tuple[str, ...] = ("model", SPLIT)
) -> DataFrame:
    return probability_metrics(scored, list(by), edges=edges)


def model_comparison(
    scored: DataFrame,
    runs: DataFrame | None = None,
    iterations: int = 1_000,
    seed: int = 42,
    edges: list[float] | None = None,
) -> DataFrame:
    """One row per model: validation macro-F1, test metrics, intervals, delta, cost columns.

    ``scored`` is long ``(model, split, label, probability)``. The per-model tables joined
    here have one row per model; what a model lacks stays null, and ``require_complete`` refuses it.
    """
    models = scored.select("model").distinct()
    if runs is not None:
        models = models.unionByName(runs.select("model")).distinct()
    metrics = split_metrics(scored.where(F.col(SPLIT).isin("validation", "test")), edges)
    validation = metrics.where(F.col(SPLIT) == "validation").select(
        "model", F.col("macro_f1").alias("validation_macro_f1")
    )
    test = metrics.where(F.col(SPLIT) == "test").select(
        "model", *[F.col(name).alias(f"test_{name}") for name in METRIC_NAMES]
    )
    intervals = bootstrap_interval(
        scored.where(F.col(SPLIT) == "test"), ["model"], iterations=iterations, seed=seed
    )
    of_metric = lambda metric, end: F.max(
        F.when(F.col("metric") == metric, F.col(f"ci_{end}"))
    ).alias(f"test_{metric}_ci_{end}")
    bounds = intervals.groupBy("model").agg(
        *[of_metric(m, end) for m in ("macro_f1", "accuracy") for end in ("low", "high")]
    )
    table = (
        models.join(validation, "model", "left")
        .join(test, "model", "left")
        .join(bounds, "model", "left")
        .withColumn("selection_split", F.lit("validation"))
        .withColumn(
            "validation_to_test_macro_f1_delta",
            F.col("test_macro_f1") - F.col("validation_macro_f1"),
        )
        .withColumn("display_name", display_name(F.col("model")))
    )
    if runs is None:
        return table
    costs = with_cost_columns(runs).select(
        "model",
        "family",
        "train_seconds",
        "inference_ms_per_sample",
        "parameter_count",
        "trainable_parameter_count",
        "artifact_bytes",
        "artifact_mib",
        "best_epoch",
        F.coalesce(F.try_element_at("metadata", F.lit("device")), F.lit("cpu")).alias("device"),
        (F.col("family") == "pretrained_vectors").alias("pretrained"),
        F.coalesce(
            F.try_element_at("metadata", F.lit("pretraining_compute_included")) == "true",
            F.lit(False),
        ).alias("pretraining_compute_included"),
    )
    return table.join(costs, "model", "left")


def require_complete(comparison: DataFrame) -> None:
    """Raise unless every model has both macro-F1 values and, if costs are compared, a run."""
    needed = ["validation_macro_f1", "test_macro_f1"]
    needed += [c for c in ("family",) if c in comparison.columns]
    lacking = F.lit(False)
    for name in needed:
        lacking |= F.col(name).isNull()
    bad = comparison.where(lacking).head(1)
    if bad:
        raise IntegrityError(f"the comparison lacks a part of model {bad[0]['model']!r}")


def require_unique_models(runs: DataFrame) -> None:
    twice = runs.groupBy("model").count().where(F.col("count") > 1).head(1)
    if twice:
        raise ValueError(f"model names must be unique: {twice[0]['model']}")


def _best_first(score: str) -> Column:
    """Descending, with NaN behind every number."""
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).desc_nulls_last()


def champion(validation_scores: DataFrame) -> DataFrame:
    """Best validation macro-F1, then model name; NaN and null come last. Test metrics play
    no part."""
    return (
        validation_scores.select("model", "validation_macro_f1")
        .orderBy(_best_first("validation_macro_f1"), "model")
        .limit(1)
    )


def select_candidate(candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Mark the best candidate per scope: highest validation score (NaN and null last), lowest
    index on ties."""
    order = W.partitionBy(*(scope or [F.lit(0)])).orderBy(
        _best_first("validation_macro_f1"), "candidate_index"
    )
    return candidates.withColumn("selected", F.row_number().over(order) == 1)


def worst_slice(metrics: DataFrame) -> DataFrame:
    """The (model, source) with the lowest macro-F1; ties go to the first names."""
    lowest = F.min(F.struct("macro_f1", "model", SOURCE)).alias("m")
    return metrics.agg(lowest).select("m.model", f"m.{SOURCE}", "m.macro_f1")


def source_pivot(metrics: DataFrame, sources: list[str], metric: str = "macro_f1") -> DataFrame:
    """Models down, sources across."""
    return metrics.groupBy("model").agg(
        *[F.max(F.when(F.col(SOURCE) == s, F.col(metric))).alias(s) for s in sources]
    )


def early_stopping(
    history: DataFrame,
    patience: int,
    by: list[str] | None = None,
    metric: str = "validation_macro_f1",
    tolerance: float = 1e-12,
) -> DataFrame:
    """Replay of a training history: epochs kept, which improved, the best and the last.

    An epoch improves when it beats the best *accepted* value by more than the tolerance, so
    the rule is a fold, not a running maximum. A history is one short list per model.
    """
    by = by or ["model"]
    epochs = history.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("epoch", F.col(metric).alias("value")))).alias("h")
    )
    row = "struct<epoch:int,value:double,is_best:boolean,since_best:int>"
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).cast("int").alias("best_epoch"),
        F.lit(0).cast("int").alias("since"),
        F.array().cast(f"array<{row}>").alias("rows"),
    )

    def step(state: Column, entry: Column) -> Column:
        better = state["best"].isNull() | (entry["value"] > state["best"] + F.lit(tolerance))
        since = F.when(better, F.lit(0)).otherwise(state["since"] + F.lit(1)).cast("int")
        stopped = state["since"] >= patience
        kept = F.struct(
            entry["epoch"].cast("int").alias("epoch"),
            entry["value"].cast("double").alias("value"),
            better.alias("is_best"),
            since.alias("since_best"),
        )
        advanced = F.struct(
            F.when(better, entry["value"]).otherwise(state["best"]).cast("double").alias("best"),
            F.when(better, entry["epoch"]).otherwise(state["best_epoch"])
            .cast("int")
            .alias("best_epoch"),
            since.alias("since"),
            F.concat(state["rows"], F.array(kept).cast(f"array<{row}>")).alias("rows"),
        )
        return F.when(stopped, state).otherwise(advanced)

    folded = epochs.select(*by, F.aggregate("h", start, step).alias("s"))
    stop = F.element_at("s.rows", -1)["epoch"]
    return folded.select(
        *by,
        F.col("s.best_epoch").alias("best_epoch"),
        stop.alias("last_epoch"),
        F.inline("s.rows"),
    ).withColumnRenamed("value", metric)
