"""Closed-form metrics, selection rules, uncertainty and stopping."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import compare, metrics, quality, resampling, uncertainty
from assayline.schema import IntegrityError

COLUMNS = "sentence_id string, source string, split string, model string, label int, probability double"


def _scored(spark, labels, probabilities, model="m", source="s", split="test"):
    rows = [(str(i), source, split, model, y, p) for i, (y, p) in enumerate(zip(labels, probabilities))]
    return spark.createDataFrame(rows, COLUMNS)


def test_closed_form(spark):
    frame = _scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    row = metrics.probability_metrics(frame, ["model"]).first()
    for name in ("accuracy", "balanced_accuracy", "macro_f1", "roc_auc", "average_precision"):
        assert row[name] == pytest.approx(1.0)
    assert row["brier_score"] == pytest.approx(0.025) and row["correct"] == 4
    ece = metrics.expected_calibration_error(frame, ["model"], bins=2).first()["ece"]
    assert ece == pytest.approx(0.15)


def _brute(labels, probabilities):
    pos = [p for y, p in zip(labels, probabilities) if y]
    neg = [p for y, p in zip(labels, probabilities) if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
    ap, recall = 0.0, 0.0
    for t in sorted(set(probabilities), reverse=True):
        tp = sum(p >= t for p in pos)
        taken = sum(p >= t for p in probabilities)
        ap += (tp / len(pos) - recall) * tp / taken
        recall = tp / len(pos)
    edges = np.linspace(0, 1, 11)
    bins = np.minimum(np.digitize(probabilities, edges[1:-1], right=True), 9)
    y, p = np.array(labels), np.array(probabilities)
    ece = sum((bins == b).mean() * abs(p[bins == b].mean() - y[bins == b].mean()) for b in set(bins))
    eps = np.finfo(float).eps
    loss = -np.mean(np.where(y == 1, np.log(np.clip(p, eps, 1 - eps)), np.log(np.clip(1 - p, eps, 1 - eps))))
    return {"roc_auc": auc, "average_precision": ap, "ece_10_bin": ece, "log_loss": loss,
            "brier_score": np.mean((p - y) ** 2)}


@pytest.mark.parametrize("edges", [[], [0.5], None, [0.0, 0.1, 0.25, 0.3, 0.9, 1.0]])
def test_against_brute_force(spark, edges):
    """Heavy ties, exact bin edges, 0 and 1; ranking is exact for any ranges."""
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 300).tolist()
    probabilities = rng.choice([*np.linspace(0, 1, 11), 0.33, 1e-9], 300).tolist()
    frame = _scored(spark, labels, probabilities).repartition(5)
    row = metrics.probability_metrics(frame, ["model"], edges=edges).first()
    for name, value in _brute(labels, probabilities).items():
        assert row[name] == pytest.approx(value, abs=1e-12), name


def test_one_sided_predictions_have_zero_division(spark):
    row = metrics.threshold_metrics(_scored(spark, [0, 1], [0.1, 0.2]), []).first()
    assert row["macro_precision"] == pytest.approx(0.25) and row["macro_f1"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("labels,probabilities", [
    ([0, 1], [float("nan"), 0.5]), ([0, 1], [1.5, 0.5]), ([0, 1], [None, 0.5]), ([1, 1], [0.1, 0.5])])
def test_unusable_input(spark, labels, probabilities):
    with pytest.raises(IntegrityError):
        quality.require_sane(_scored(spark, labels, probabilities), ["model"])


def _two_models(spark):
    """Model ``good`` wins on validation and fails on test; ``plain`` the other way round."""
    rows = []
    for split, good, plain in (("validation", [0.1, 0.9], [0.4, 0.6]), ("test", [0.9, 0.1], [0.4, 0.6])):
        for model, probs in (("good", good), ("plain", plain)):
            for i in range(8):
                wrong = split == "validation" and model == "plain" and i < 2
                p = 1 - probs[i % 2] if wrong else probs[i % 2]
                rows.append((f"{split}{i}", "ab"[i % 4 // 2], split, model, i % 2, p))
    return spark.createDataFrame(rows, COLUMNS)


def test_champion_never_sees_test(spark):
    table = compare.model_comparison(_two_models(spark), iterations=20).cache()
    assert compare.champion(table).first()["model"] == "good"
    scores = {r["model"]: r["test_macro_f1"] for r in table.collect()}
    assert scores == {"good": 0.0, "plain": 1.0}


def test_alignment(spark):
    scored = _two_models(spark)
    expected = scored.where("model = 'good'").select("split", "sentence_id")
    compare.require_aligned(scored, expected)
    for bad in (scored.where("model <> 'plain' or sentence_id <> 'test3'"),
                scored.union(scored.limit(1)),
                scored.withColumn("sentence_id", F.concat("sentence_id", F.lit("x")))):
        with pytest.raises(IntegrityError):
            compare.require_aligned(bad, expected)


def test_unique_models(spark):
    runs = spark.createDataFrame([("a",), ("a",)], "model string")
    with pytest.raises(ValueError):
        compare.require_unique_models(runs)


def test_bootstrap_is_the_row_bootstrap(spark):
    """Same interval whatever the partitioning, and close to resampling rows."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.clip(y * 0.3 + rng.random(400) * 0.7, 0, 1)
    frame = _scored(spark, y.tolist(), p.tolist())
    get = lambda f: uncertainty.bootstrap_interval(f, ["model"], iterations=2000).orderBy("metric").collect()
    first = get(frame.repartition(1))
    assert first == get(frame.repartition(7))
    hits = (p >= 0.5) == y
    draws = [hits[rng.integers(0, 400, 400)].mean() for _ in range(2000)]
    low, high = np.percentile(draws, [2.5, 97.5])
    row = [r for r in first if r["metric"] == "accuracy"][0]
    assert row["point"] == pytest.approx(hits.mean())
    assert row["ci_low"] == pytest.approx(low, abs=0.01)
    assert row["ci_high"] == pytest.approx(high, abs=0.01)


def test_paired_delta_of_equal_models_is_zero(spark):
    wide = spark.createDataFrame(
        [(i % 2, float(i % 3 > 0), float(i % 3 > 0)) for i in range(60)],
        "label int, a_probability double, b_probability double")
    rows = uncertainty.paired_bootstrap(
        uncertainty.joint_cells(wide, ["a", "b"], "a"), iterations=50).collect()
    assert len(rows) == 2
    assert all(r["delta"] == r["ci_low"] == r["ci_high"] == 0.0 for r in rows)


# Published validation macro-F1 by epoch: stops at 12 with epoch 8 best under patience 4.
HISTORY = [0.6439, 0.6536, 0.6745, 0.6667, 0.6607, 0.6904, 0.6999, 0.7231, 0.7215, 0.7225, 0.7055, 0.7226]


def _replay(spark, values, patience):
    frame = spark.createDataFrame([("m", i + 1, v) for i, v in enumerate(values)],
                                  "model string, epoch int, validation_macro_f1 double")
    return compare.early_stopping(frame.repartition(3), patience).orderBy("epoch").collect()


def test_early_stopping_replay(spark):
    rows = _replay(spark, [*HISTORY, 0.99], 4)
    assert (rows[0]["best_epoch"], rows[0]["last_epoch"], len(rows)) == (8, 12, 12)
    assert [r["epoch"] for r in rows if r["is_best"]] == [1, 2, 3, 6, 7, 8]
    assert _replay(spark, [0.9262, 0.9379, 0.9345], 2)[0]["best_epoch"] == 2


def test_early_stopping_near_ties_do_not_creep(spark):
    """Steps below the tolerance never count, even when they add up to more than it."""
    rows = _replay(spark, [0.5, 0.5 + 6e-13, 0.5 + 1.2e-12], 5)
    assert [r["is_best"] for r in rows] == [True, False, True]
    assert [r["is_best"] for r in _replay(spark, [0.5, 0.5 + 6e-13, 0.5 + 9e-13], 5)] == [True, False, False]


def test_candidate_ties_take_the_lowest_index(spark):
    frame = spark.createDataFrame([(0, 0.5), (2, 0.7), (1, 0.7)], "candidate_index int, validation_macro_f1 double")
    assert compare.select_candidate(frame).where("selected").first()["candidate_index"] == 1


def test_cost_columns_and_ratios(spark):
    runs = spark.createDataFrame(
        [("tfidf_logistic_regression", 0.5, 0.0, 0, 100, 0), ("x", 5.0, 2.0, 1000, 1000, 2**20)],
        "model string, train_seconds double, inference_seconds double, inference_samples bigint, "
        "parameter_count bigint, artifact_bytes bigint")
    costs = compare.with_cost_columns(runs)
    row = costs.where("model = 'x'").first()
    assert (row["inference_ms_per_sample"], row["artifact_mib"]) == (2.0, 1.0)
    assert costs.where("model <> 'x'").first()["inference_ms_per_sample"] == 0.0
    ratios = compare.cost_ratios(costs, compare.BASELINE).where("model = 'x'").first()
    assert ratios["train_seconds_ratio"] == 10.0 and ratios["artifact_bytes_ratio"] == 2.0**20


def test_a_model_without_a_whole_split_is_not_aligned(spark):
    assigned = spark.createDataFrame([("1", "validation"), ("2", "test")], "sentence_id string, split string")
    rows = [("a", "validation", "1", 0.5), ("a", "test", "2", 0.5), ("b", "validation", "1", 0.5)]
    predictions = spark.createDataFrame(rows, "model string, split string, sentence_id string, probability double")
    found = {(r.model, r.split): r.missing for r in compare.prediction_alignment(predictions, assigned).collect()}
    assert found == {("a", "validation"): 0, ("a", "test"): 0, ("b", "validation"): 0, ("b", "test"): 1}
    with pytest.raises(IntegrityError, match="aligned"):
        compare.require_aligned(predictions, assigned)


def test_a_model_without_validation_rows_stays_and_is_refused(spark):
    rows = [(m, s, y, 0.9 if y else 0.1) for m, s in (("a", "validation"), ("a", "test"), ("b", "test")) for y in (0, 1, 0, 1)]
    scored = spark.createDataFrame(rows, "model string, split string, label bigint, probability double")
    table = compare.model_comparison(scored, iterations=20)
    assert {r.model: r.validation_macro_f1 for r in table.collect()} == {"a": 1.0, "b": None}
    with pytest.raises(IntegrityError, match="'b'"):
        compare.require_complete(table)


def test_nan_scores_are_never_selected(spark):
    rows = [(0, float("nan")), (1, 0.4), (2, None), (3, 0.4)]
    table = spark.createDataFrame(rows, "candidate_index int, validation_macro_f1 double")
    assert [r.candidate_index for r in compare.select_candidate(table).where("selected").collect()] == [1]
    models = table.selectExpr("cast(candidate_index as string) as model", "validation_macro_f1")
    assert compare.champion(models).first()["model"] == "1"


def _metric_values(p, y):
    """ROC AUC, average precision, Brier score, log loss, calibration error and a mean, from the rows."""
    order = np.argsort(p)
    cells, at = np.unique(p, return_inverse=True)
    pos, neg = np.bincount(at, y), np.bincount(at, 1 - y)
    below = np.cumsum(neg) - neg
    tp, fp = np.cumsum(pos[::-1])[::-1], np.cumsum(neg[::-1])[::-1]
    bins = np.searchsorted(np.linspace(0, 1, 11)[1:-1], p)
    gap = sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(10))
    assert len(order) == len(p)
    return {
        "roc_auc": (pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum()),
        "average_precision": (pos / pos.sum() * tp / (tp + fp)).sum(),
        "brier_score": ((p - y) ** 2).mean(), "ece_10_bin": gap / len(p), "hinge": np.where(y == 1, 1 - p, 3 * p).mean(),
    }


def test_intervals_of_any_metric_are_those_of_a_row_bootstrap(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group, n in (("a", 500), ("b", 200)):
        p = rng.integers(1, 60, n) / 60
        rows += [(group, float(x), int(rng.random() < 0.2 + 0.6 * x)) for x in p]
    rows += [("one class", 0.5, 1)] * 5
    scored = spark.createDataFrame(rows, "model string, probability double, label int")
    means = {"brier_score": resampling.MEANS["brier_score"], "hinge": lambda p: (1 - p, 3 * p)}
    found = {}
    for edges in ([], [0.2, 0.21, 0.8]):
        table = resampling.probability_intervals(scored.repartition(3), ["model"], means, 400, edges=edges)
        found[len(edges)] = {(r.model, r.metric): (r.point, r.ci_low, r.ci_high) for r in table.collect()}
    assert found[0].keys() == found[3].keys() and len(found[0]) == 10  # ranges change nothing
    for key, values in found[0].items():
        assert values == pytest.approx(found[3][key], abs=1e-9)
    for group in "ab":
        p, y = (np.array(x) for x in zip(*[(r[1], r[2]) for r in rows if r[0] == group]))
        drawn = []
        for _ in range(400):
            at = rng.integers(0, len(p), len(p))
            drawn.append(_metric_values(p[at], y[at]))
        for metric, value in _metric_values(p, y).items():
            point, low, high = found[0][group, metric]
            a, b = np.percentile([d[metric] for d in drawn], [2.5, 97.5])
            assert point == pytest.approx(value, abs=1e-9)
            assert 0.8 < (high - low) / (b - a) < 1.25 and abs(low + high - a - b) / 2 < 0.25 * (b - a)
