"""Threshold, ranking and calibration metrics of scored rows, per group, in one pass.

All metrics are functions of *cells*: for each group and distinct probability, how many
positives and negatives carry it. Building cells is one aggregation with map-side combine;
everything after it works on them.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayline.functions.probability import (
    calibration_bin,
    predicted_label,
    true_class_loss,
)
from assayline.schema import DECISION_THRESHOLD, LABEL, SOURCE

EDGE_COUNT = 2_000
_P = "probability"

METRIC_NAMES = (
    "accuracy",
    "balanced_accuracy",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "roc_auc",
    "average_precision",
    "brier_score",
    "log_loss",
    "ece_10_bin",
    "predicted_positive_rate",
    "correct",
)


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def threshold_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Metrics that depend on the four confusion counts only."""
    total = tn + fp + fn + tp
    recall_0, recall_1 = _ratio(tn, tn + fp), _ratio(tp, tp + fn)
    precision_0, precision_1 = _ratio(tn, tn + fn), _ratio(tp, tp + fp)
    f1_0, f1_1 = _ratio(2 * tn, 2 * tn + fp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    return {
        "accuracy": (tn + tp) / total,
        "balanced_accuracy": (recall_0 + recall_1) / 2,
        "macro_precision": (precision_0 + precision_1) / 2,
        "macro_recall": (recall_0 + recall_1) / 2,
        "macro_f1": (f1_0 + f1_1) / 2,
        "predicted_positive_rate": (tp + fp) / total,
        "correct": tn + tp,
    }


def confusion_counts(
    scored: DataFrame, by: list[str], threshold: float = DECISION_THRESHOLD
) -> DataFrame:
    """``tn, fp, fn, tp`` per group: one aggregation, four counters."""
    hit, actual = predicted_label(F.col(_P), threshold), F.col(LABEL)
    return scored.groupBy(*by).agg(
        F.count_if((actual == 0) & (hit == 0)).alias("tn"),
        F.count_if((actual == 0) & (hit == 1)).alias("fp"),
        F.count_if((actual == 1) & (hit == 0)).alias("fn"),
        F.count_if((actual == 1) & (hit == 1)).alias("tp"),
    )


def confusion_matrix(
    scored: DataFrame, by: list[str], threshold: float = DECISION_THRESHOLD
) -> DataFrame:
    """Long form ``(by, actual, predicted, rows)`` with all four cells present."""
    cell = lambda a, p, name: F.struct(
        F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("rows")
    )
    cells = F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return confusion_counts(scored, by, threshold).select(*by, F.inline(cells))


def threshold_metrics(
    scored: DataFrame, by: list[str], threshold: float = DECISION_THRESHOLD
) -> DataFrame:
    counts = confusion_counts(scored, by, threshold)
    columns = threshold_columns(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return counts.select(*by, *[c.alias(name) for name, c in columns.items()])


def score_cells(scored: DataFrame, by: list[str]) -> DataFrame:
    """``(by, probability, pos, neg)``: one row per distinct probability."""
    return scored.groupBy(*by, _P).agg(
        F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg")
    )


def probability_edges(scored: DataFrame, count: int = EDGE_COUNT) -> list[float]:
    """Quantiles of the probabilities that cut them into ranges of similar size.

    A mergeable sketch over one column; the answer is ``count`` numbers. Ranking metrics are
    exact for any edges, these only balance the work. A probability many rows share is one
    cell, so it cannot overload its range.
    """
    steps = [i / count for i in range(1, count)]
    return sorted(set(scored.approxQuantile(_P, steps, 1 / (2 * count))))


def ranked_cells(cells: DataFrame, by: list[str], edges: list[float]) -> DataFrame:
    """Cells with the positives and negatives strictly below, and group totals.

    Running counts are taken inside probability ranges, then shifted by the totals of the
    ranges below, so no group is ordered in a single task.
    """
    if edges:
        splits = [float("-inf"), *edges, float("inf")]
        cells = Bucketizer(splits=splits, inputCol=_P, outputCol="_range").transform(cells)
    else:
        cells = cells.withColumn("_range", F.lit(0.0))
    ranges = cells.groupBy(*by, "_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    group = W.partitionBy(*by)
    lower = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        *by,
        "_range",
        F.coalesce(F.sum("p").over(lower), F.lit(0)).alias("_p_offset"),
        F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("_n_offset"),
        F.sum("p").over(group).alias("positives"),
        F.sum("n").over(group).alias("negatives"),
    )
    below = W.partitionBy(*by, "_range").orderBy(_P).rowsBetween(W.unboundedPreceding, -1)
    local = cells.withColumns(
        {
            "_p_local": F.coalesce(F.sum("pos").over(below), F.lit(0)),
            "_n_local": F.coalesce(F.sum("neg").over(below), F.lit(0)),
        }
    )
    return local.join(offsets, [*by, "_range"]).select(
        *by,
        _P,
        "pos",
        "neg",
        "positives",
        "negatives",
        (F.col("_p_local") + F.col("_p_offset")).alias("pos_below"),
        (F.col("_n_local") + F.col("_n_offset")).alias("neg_below"),
    )


def _auc_part() -> Column:
    pairs = F.col("positives") * F.col("negatives").cast("double")
    return F.col("pos") * (F.col("neg_below") + F.col("neg") / 2) / pairs


def _ap_part() -> Column:
    """Recall gained at this threshold times the precision at it."""
    tp = F.col("positives") - F.col("pos_below")
    fp = F.col("negatives") - F.col("neg_below")
    return F.col("pos") / F.col("positives") * (tp / (tp + fp))


def _auto(scored: DataFrame, edges: list[float] | None) -> list[float]:
    return probability_edges(scored) if edges is None else edges


def roc_auc(scored: DataFrame, by: list[str], edges: list[float] | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; exact."""
    ranked = ranked_cells(score_cells(scored, by), by, _auto(scored, edges))
    return ranked.groupBy(*by).agg(F.sum(_auc_part()).alias("roc_auc"))


def average_precision(
    scored: DataFrame, by: list[str], edges: list[float] | None = None
) -> DataFrame:
    """Precision at each distinct threshold weighted by the recall it adds; exact."""
    ranked = ranked_cells(score_cells(scored, by), by, _auto(scored, edges))
    return ranked.groupBy(*by).agg(F.sum(_ap_part()).alias("average_precision"))


def brier_score(scored: DataFrame, by: list[str]) -> DataFrame:
    error = F.col(_P) - F.col(LABEL)
    return scored.groupBy(*by).agg(F.avg(error * error).alias("brier_score"))


def log_loss(scored: DataFrame, by: list[str]) -> DataFrame:
    positive, negative = true_class_loss(F.col(_P), 1 - F.col(_P))
    loss = F.when(F.col(LABEL) == 1, positive).otherwise(negative)
    return scored.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def calibration_curve(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Mean probability and observed positive rate of each non-empty bin."""
    return scored.groupBy(*by, calibration_bin(F.col(_P), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(_P).alias("mean_probability"),
        F.avg(LABEL).alias("positive_rate"),
    )


def expected_calibration_error(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    curve = calibration_curve(scored, by, bins)
    gap = F.col("rows") * F.abs(F.col("mean_probability") - F.col("positive_rate"))
    return curve.groupBy(*by).agg((F.sum(gap) / F.sum("rows")).alias("ece"))


def probability_metrics(
    scored: DataFrame,
    by: list[str],
    threshold: float = DECISION_THRESHOLD,
    edges: list[float] | None = None,
) -> DataFrame:
    """All twelve metrics per group from one set of cells.

    Cells are ranked once, summed per calibration bin, and the few bin rows per group then
    give every metric; no metric re-reads or re-joins the scored rows.
    """
    ranked = ranked_cells(score_cells(scored, by), by, _auto(scored, edges))
    p, pos, neg = F.col(_P), F.col("pos"), F.col("neg")
    hit = predicted_label(p, threshold)
    loss_1, loss_0 = true_class_loss(p, 1 - p)
    bins = ranked.groupBy(*by, calibration_bin(p).alias("_bin")).agg(
        F.sum(pos + neg).alias("n"),
        F.sum(pos).alias("pos"),
        F.sum(p * (pos + neg)).alias("p_sum"),
        F.sum(neg * (1 - hit)).alias("tn"),
        F.sum(neg * hit).alias("fp"),
        F.sum(pos * (1 - hit)).alias("fn"),
        F.sum(pos * hit).alias("tp"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("squares"),
        F.sum(pos * loss_1 + neg * loss_0).alias("loss"),
        F.sum(_auc_part()).alias("auc"),
        F.sum(_ap_part()).alias("ap"),
    )
    totals = bins.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "tn", "fp", "fn", "tp", "squares", "loss")],
        F.sum("auc").alias("roc_auc"),
        F.sum("ap").alias("average_precision"),
        F.sum(F.abs(F.col("p_sum") - F.col("pos"))).alias("gap"),
    )
    columns = threshold_columns(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    columns |= {
        "roc_auc": F.col("roc_auc"),
        "average_precision": F.col("average_precision"),
        "brier_score": F.col("squares") / F.col("n"),
        "log_loss": F.col("loss") / F.col("n"),
        "ece_10_bin": F.col("gap") / F.col("n"),
    }
    return totals.select(*by, *[columns[name].alias(name) for name in METRIC_NAMES])


def source_metrics(
    scored: DataFrame, edges: list[float] | None = None, by: list[str] | None = None
) -> DataFrame:
    """All metrics per model, overall (``is_overall``) and for every source, in one pass."""
    by = by or ["model"]
    slices = F.array(
        F.struct(F.lit(True).alias("is_overall"), F.lit("").alias("_slice")),
        F.struct(F.lit(False).alias("is_overall"), F.col(SOURCE).alias("_slice")),
    )
    sliced = scored.select(*by, LABEL, _P, F.inline(slices)).withColumnRenamed("_slice", SOURCE)
    return probability_metrics(sliced, [*by, "is_overall", SOURCE], edges=_auto(scored, edges))
