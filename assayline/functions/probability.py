"""Column functions over probabilities: decision, sanity, logits, calibration bins."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.schema import DECISION_THRESHOLD

# Logits beyond this are cut; float64 machine epsilon bounds the log loss.
LOGIT_LIMIT = 80.0
EPSILON = sys.float_info.epsilon


def predicted_label(probability: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    """1 where the probability reaches the threshold; a tie counts as positive."""
    return (probability >= F.lit(threshold)).cast("int")


def sentiment(label: Column) -> Column:
    return F.when(label == 1, F.lit("positive")).otherwise(F.lit("negative"))


def is_bad_probability(probability: Column) -> Column:
    return (
        probability.isNull() | F.isnan(probability) | ~probability.between(F.lit(0.0), F.lit(1.0))
    )


def logit_to_probability(logit: Column) -> Column:
    cut = F.greatest(F.lit(-LOGIT_LIMIT), F.least(F.lit(LOGIT_LIMIT), logit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-cut))


def softmax_positive(negative_logit: Column, positive_logit: Column) -> Column:
    """Second entry of a two-class softmax, which is a sigmoid of the difference."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(negative_logit - positive_logit))


def true_class_loss(positive: Column, negative: Column) -> tuple[Column, Column]:
    """Negative log of the probabilities of either class, bounded away from 0 and 1."""

    def bounded(value: Column) -> Column:
        return F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), value))

    return -F.log(bounded(positive)), -F.log(bounded(negative))


def calibration_edges(bins: int = 10) -> list[float]:
    """Inner edges of equal-width bins; their float64 values differ from i / bins in places."""
    return [float(edge) for edge in np.linspace(0.0, 1.0, bins + 1)[1:-1]]


def calibration_bin(probability: Column, bins: int = 10) -> Column:
    """Right-closed equal-width bin: the number of inner edges below the probability."""
    index = F.lit(0)
    for edge in calibration_edges(bins):
        index = index + (probability > F.lit(edge)).cast("int")
    return index
