"""Queries over scored rows: metrics, uncertainty, comparison, cost and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.probability import (
    EPSILON,
    calibration_edges,
    logit_to_probability,
    predicted_label,
    sentiment,
    softmax_positive,
)
from assayline.operators import compare, metrics, resampling, uncertainty
from assayline.operators.quality import probability_sanity as sanity
from assayline.plans import views
from assayline.plans.views import rounded, sql
from assayline.session import table

_TYPES = ["click", "error", "purchase", "signup", "view"]
_PATIENCE = 3


def threshold_predict(spark: SparkSession, folder: str) -> DataFrame:
    label = predicted_label(F.col("probability"))
    return views.scored(spark, folder).select(
        "sentence_id",
        "model",
        label.alias("predicted_label"),
        sentiment(label).alias("predicted_sentiment"),
    )


def probability_sanity(spark: SparkSession, folder: str) -> DataFrame:
    """Event values scaled so that some leave [0, 1]."""
    rows = views.scored_wide(spark, folder).select(
        "source", "label", (F.col("value") / 100.0).alias("probability")
    )
    return sanity(rows, ["source"])


def logits(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    logit = (F.col("value") - 50.0) * 2.0
    return rounded(
        events.select(
            "event_id",
            logit_to_probability(logit).alias("probability"),
            softmax_positive(F.lit(0.0), F.col("value") - 50.0).alias("softmax"),
        ),
        12,
    )


def _by_model(operator, digits: int = 9):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(operator(views.scored(spark, folder), ["model", "source"]), digits)

    return query


def source_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.source_metrics(views.scored(spark, folder)))


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.threshold_metrics(views.scored(spark, folder), ["model", "source"])


def _judged(intervals: DataFrame, of: str) -> DataFrame:
    """Intervals as facts that SQL can tell: the point, the resamples used, and whether the
    interval brackets the point without being of no width."""
    held = (F.col("ci_low") <= F.col(of)) & (F.col(of) <= F.col("ci_high")) & (F.col("ci_low") < F.col("ci_high"))
    return rounded(intervals.withColumn("brackets", held).drop("ci_low", "ci_high"))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals, judged; that of the accuracy also by its width, within a fifth of the normal one."""
    rows = views.scored(spark, folder)
    found = uncertainty.bootstrap_interval(rows, ["model"]).join(
        rows.groupBy("model").agg(F.count("*").alias("n")), "model"
    )
    normal = 2 * 1.959964 * F.sqrt(F.col("point") * (1 - F.col("point")) / F.col("n"))
    ratio = (F.col("ci_high") - F.col("ci_low")) / normal
    near = F.when(F.col("metric") == "accuracy", ratio.between(0.8, 1.25))
    return _judged(found.withColumn("normal_width", near).drop("n"), "point")


def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(uncertainty.paired_bootstrap(_cells(spark, folder)), "delta")


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    return compare.wide_predictions(views.scored(spark, folder), ["a", "b"])


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return uncertainty.joint_cells(_wide(spark, folder), ["a", "b"], "a")


def _youden(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return tp / (tp + fn) + tn / (tn + fp) - 1


def custom_metric(spark: SparkSession, folder: str) -> DataFrame:
    """A metric of the caller's own, over confusion counts."""
    chosen = {"youden": _youden}
    rows = views.scored(spark, folder)
    return rounded(uncertainty.metric_values(rows, ["model", "source"], chosen))


def custom_metric_ci(spark: SparkSession, folder: str) -> DataFrame:
    chosen = {"youden": _youden}
    return _judged(uncertainty.bootstrap_interval(views.scored(spark, folder), ["model"], chosen), "point")


_NORMAL = 2 * 1.959964


def _normal_widths(rows: DataFrame) -> DataFrame:
    """Widths of the normal intervals of the means, and of DeLong's of the ROC AUC."""
    cells = metrics.ranked_cells(metrics.score_cells(rows, ["model"]), ["model"], metrics.probability_edges(rows))
    p, pos, neg = F.col("probability"), F.col("pos"), F.col("neg")
    above = (F.col("neg_below") + neg / 2) / F.col("negatives")
    below = (F.col("positives") - F.col("pos_below") - pos / 2) / F.col("positives")
    sums = [F.max("positives").alias("p"), F.max("negatives").alias("n"), F.sum(pos * above).alias("a1"),
            F.sum(pos * above * above).alias("a2"), F.sum(neg * below * below).alias("a3")]
    for name, mean in resampling.MEANS.items():
        one, zero = mean(p)
        sums += [F.sum(pos * one + neg * zero).alias(f"{name}_1"), F.sum(pos * one * one + neg * zero * zero).alias(f"{name}_2")]
    found = cells.groupBy("model").agg(*sums)
    auc, count = F.col("a1") / F.col("p"), F.col("p") + F.col("n")
    spread = (F.col("a2") / F.col("p") - auc * auc) / F.col("p") + (F.col("a3") / F.col("n") - auc * auc) / F.col("n")
    widths = {"roc_auc": F.sqrt(spread)}
    for name in resampling.MEANS:
        mean = F.col(f"{name}_1") / count
        widths[name] = F.sqrt((F.col(f"{name}_2") / count - mean * mean) / count)
    each = F.array(*[F.struct(F.lit(n).alias("metric"), (w * _NORMAL).alias("normal_width")) for n, w in widths.items()])
    return found.select("model", F.inline(each))


def probability_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of metrics of the probabilities: the points, the widths by formula where there is one,
    how many times as wide (in halves) the bootstrap's are, and whether those lie around the point. (A
    calibration error near 0 only grows in resamples.)"""
    rows = views.scored(spark, folder)
    found = resampling.probability_intervals(rows, ["model"])
    width, middle = F.col("ci_high") - F.col("ci_low"), (F.col("ci_high") + F.col("ci_low")) / 2
    return found.join(_normal_widths(rows), ["model", "metric"], "left").select(
        "model", "metric", F.round("point", 9).alias("point"), "used_iterations",
        F.round("normal_width", 9).alias("normal_width"),
        (F.round(2 * width / F.col("normal_width")) / 2).alias("times_as_wide"),
        F.when(F.col("normal_width").isNotNull(), F.abs(middle - F.col("point")) < width / 4).alias("centred"),
    )


def prediction_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Model a is complete; b lacks errors, repeats clicks and files views elsewhere; c has no
    test predictions at all."""
    rows = views.scored(spark, folder)
    other = F.when(F.col("split") == "test", "validation").otherwise("test")
    moved = F.when((F.col("model") == "b") & (F.col("source") == "view"), other)
    predicted = rows.where((F.col("model") == "a") | (F.col("source") != "error")).withColumn(
        "split", F.coalesce(moved, "split")
    )
    again = rows.where((F.col("model") == "b") & (F.col("source") == "click"))
    expected = views.scored_wide(spark, folder).select(
        F.col("id").cast("string").alias("sentence_id"), "split"
    )
    partial = rows.where((F.col("model") == "a") & (F.col("split") == "validation"))
    every = predicted.unionByName(again).unionByName(partial.withColumn("model", F.lit("c")))
    return compare.prediction_alignment(every, expected)


def _with_judged_bounds(table_: DataFrame) -> DataFrame:
    """The comparison with a verdict on each interval in place of its ends."""
    held = {}
    for metric in ("macro_f1", "accuracy"):
        low, high = (F.col(f"test_{metric}_ci_{end}") for end in ("low", "high"))
        held[f"test_{metric}_bracketed"] = F.col(f"test_{metric}").between(low, high) & (low < high)
    ends = [f"test_{m}_ci_{e}" for m in ("macro_f1", "accuracy") for e in ("low", "high")]
    return rounded(table_.withColumns(held).drop(*ends))


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Both models, and one without validation rows, which keeps its row."""
    rows = views.scored(spark, folder)
    half = rows.where((F.col("model") == "a") & (F.col("split") == "test"))
    table_ = compare.model_comparison(rows.unionByName(half.withColumn("model", F.lit("c"))))
    return _with_judged_bounds(table_)


def model_comparison_ci(spark: SparkSession, folder: str) -> DataFrame:
    """The whole comparison row, with intervals and the costs of standing-in runs."""
    rows = views.scored(spark, folder)
    named = rows.withColumn("model", F.concat_ws("-", "source", "model"))
    runs = views.event_runs(spark, folder).withColumns(
        {
            "model": F.concat_ws("-", "model", F.lit("a")),
            "family": F.lit("traditional"),
            "trainable_parameter_count": F.col("parameter_count"),
            "best_epoch": F.lit(None).cast("int"),
            "metadata": F.create_map(F.lit("device"), F.lit("cpu")),
        }
    )
    chosen = ["model", "validation_macro_f1", "test_macro_f1", "test_accuracy", "family", "parameter_count",
              "artifact_bytes", "device", "pretrained", "test_macro_f1_bracketed", "test_accuracy_bracketed"]
    return _with_judged_bounds(compare.model_comparison(named, runs)).select(*chosen)


def champion(spark: SparkSession, folder: str) -> DataFrame:
    """Every (source, model) pair stands as a model of its own."""
    rows = views.scored(spark, folder).where(F.col("split") == "validation")
    named = rows.withColumn("model", F.concat_ws("-", "source", "model"))
    scores = metrics.threshold_metrics(named, ["model"]).select(
        "model", F.col("macro_f1").alias("validation_macro_f1")
    )
    return rounded(compare.champion(scores))


def _hourly(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.long_form_with(views.scored_wide(spark, folder), F.hour("ts"), "candidate_index")
    scores = metrics.threshold_metrics(rows, ["model", "candidate_index"])
    return scores.select(
        "model", "candidate_index", F.round("macro_f1", 6).alias("validation_macro_f1")
    )


def select_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of the day as candidates of each model."""
    return compare.select_candidate(_hourly(spark, folder), ["model"])


def early_stopping(spark: SparkSession, folder: str) -> DataFrame:
    """Days as epochs of each event type, scored by model a."""
    wide = views.scored_wide(spark, folder)
    daily = wide.select(
        F.col("source").alias("model"),
        F.dayofmonth("ts").alias("epoch"),
        "label",
        F.col("p_a").alias("probability"),
    )
    history = metrics.threshold_metrics(daily, ["model", "epoch"]).select(
        "model", "epoch", F.round("macro_f1", 6).alias("validation_macro_f1")
    )
    return compare.early_stopping(history, _PATIENCE)


def cost_columns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.with_cost_columns(views.event_runs(spark, folder)), 6)


def cost_ratios(spark: SparkSession, folder: str) -> DataFrame:
    costs = compare.with_cost_columns(views.event_runs(spark, folder))
    return rounded(compare.cost_ratios(costs, "click"), 6)


QUERIES = {
    "threshold_predict": threshold_predict,
    "probability_sanity": probability_sanity,
    "logit_to_probability": logits,
    "confusion_matrix": lambda s, f: metrics.confusion_matrix(views.scored(s, f), ["model"]),
    "threshold_metrics": _by_model(metrics.threshold_metrics),
    "roc_auc": _by_model(metrics.roc_auc),
    "average_precision": _by_model(metrics.average_precision),
    "brier_score": _by_model(metrics.brier_score),
    "log_loss": _by_model(metrics.log_loss),
    "ece": _by_model(metrics.expected_calibration_error),
    "calibration_curve": _by_model(metrics.calibration_curve),
    "source_metrics": source_metrics,
    "custom_metric": custom_metric,
    "custom_metric_ci": custom_metric_ci,
    "bootstrap_ci": bootstrap_ci,
    "probability_intervals": probability_intervals,
    "paired_bootstrap": paired_bootstrap,
    "paired_deltas": lambda s, f: rounded(uncertainty.paired_deltas(_cells(s, f))),
    "prediction_alignment": prediction_alignment,
    "wide_predictions": _wide,
    "disagreements": lambda s, f: compare.disagreements(_wide(s, f), ["a", "b"]),
    "model_comparison": model_comparison,
    "model_comparison_ci": model_comparison_ci,
    "champion": champion,
    "select_candidate": select_candidate,
    "early_stopping": early_stopping,
    "worst_slice": lambda s, f: rounded(compare.worst_slice(_slices(s, f))),
    "source_pivot": lambda s, f: rounded(compare.source_pivot(_slices(s, f), _TYPES)),
    "cost_columns": cost_columns,
    "cost_ratios": cost_ratios,
}


def _counts(by: str, view: str = "scored") -> str:
    cell = lambda a, p: f"count(*) filter (label = {a} and (probability >= 0.5) = {p})"
    return (
        f"select {by}, {cell(0, 'false')} as tn, {cell(0, 'true')} as fp, "
        f"{cell(1, 'false')} as fn, {cell(1, 'true')} as tp from {view} group by {by}"
    )


def _div(top: str, bottom: str) -> str:
    return f"case when {bottom} = 0 then 0.0 else ({top}) / cast({bottom} as double) end"


_F1 = f"({_div('2*tn', '(2*tn+fp+fn)')} + {_div('2*tp', '(2*tp+fp+fn)')}) / 2"
_RECALL = f"({_div('tn', '(tn+fp)')} + {_div('tp', '(tp+fn)')}) / 2"
_PRECISION = f"({_div('tn', '(tn+fn)')} + {_div('tp', '(tp+fp)')}) / 2"
_ACCURACY = "(tn+tp) / cast(tn+fp+fn+tp as double)"
_THRESHOLD = (
    f"round({_ACCURACY}, 9) as accuracy, round({_RECALL}, 9) as balanced_accuracy, "
    f"round({_PRECISION}, 9) as macro_precision, round({_RECALL}, 9) as macro_recall, "
    f"round({_F1}, 9) as macro_f1, "
    "round((tp+fp) / cast(tn+fp+fn+tp as double), 9) as predicted_positive_rate, "
    "tn+tp as correct"
)
_BIN = " + ".join(f"cast(probability > cast({e!r} as double) as int)" for e in calibration_edges())
_LOSS = (
    f"-ln(greatest(cast({EPSILON!r} as double), least(cast({1 - EPSILON!r} as double), "
    "case when label = 1 then probability else 1 - probability end)))"
)


def _ranking(by: str, view: str = "scored") -> str:
    """Cells with what lies at or above each distinct probability."""
    down = f"over (partition by {by} order by probability desc)"
    return (
        f"select *, sum(pos) {down} as tp_at, sum(neg) {down} as fp_at, "
        f"sum(pos) over (partition by {by}) as p, sum(neg) over (partition by {by}) as n from ("
        f"select {by}, probability, count(*) filter (label = 1) as pos, "
        f"count(*) filter (label = 0) as neg from {view} group by {by}, probability)"
    )


_AUC = "sum(pos * (n - fp_at + neg / 2.0)) / (any_value(p) * cast(any_value(n) as double))"
_AP = "sum(pos / cast(p as double) * tp_at / (tp_at + fp_at))"


def _ece(by: str, view: str = "scored") -> str:
    return (
        f"select {by}, sum(c * abs(mp - my)) / sum(c) as ece from (select {by}, {_BIN} as bin, "
        f"count(*) as c, avg(probability) as mp, avg(label) as my from {view} "
        f"group by {by}, bin) group by {by}"
    )


def _all_metrics(by: str, view: str) -> str:
    using = f"using ({by})"
    return (
        f"select {by}, {_THRESHOLD}, round(roc_auc, 9) as roc_auc, "
        "round(average_precision, 9) as average_precision, round(brier, 9) as brier_score, "
        "round(loss, 9) as log_loss, round(ece, 9) as ece_10_bin "
        f"from ({_counts(by, view)}) "
        f"join (select {by}, {_AUC} as roc_auc, {_AP} as average_precision "
        f"from ({_ranking(by, view)}) group by {by}) {using} "
        f"join (select {by}, avg((probability - label) * (probability - label)) as brier, "
        f"avg({_LOSS}) as loss from {view} group by {by}) {using} "
        f"join ({_ece(by, view)}) {using}"
    )


_MS = "model, source"
_WIDE_ROWS = """select cast(id as varchar) as sentence_id, source, label,
  p_a as a_probability, cast(p_a >= 0.5 as int) as a_prediction,
  p_b as b_probability, cast(p_b >= 0.5 as int) as b_prediction from wide"""
_RUNS = """runs as (select event_type as model, sum(value) as train_seconds,
  sum(value) / 1000 as inference_seconds, count(*) filter (value > 10) as inference_samples,
  count(*) as parameter_count, sum(strlen(props)) as artifact_bytes
  from events group by event_type)"""
_COSTS = """costs as (select *, case when inference_samples <= 0 then 0.0
    else 1000.0 * inference_seconds / inference_samples end as inference_ms_per_sample,
  artifact_bytes / 1048576.0 as artifact_mib from runs)"""
_RENAMED = [
    "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "roc_auc",
    "average_precision", "brier_score", "log_loss", "ece_10_bin", "predicted_positive_rate",
    "correct",
]


def _delta(metric: str, expression: str) -> str:
    return (
        f"select 'b' as candidate, 'a' as reference, '{metric}' as metric, "
        f"round(max(v) filter (model = 'b') - max(v) filter (model = 'a'), 9) as delta "
        f"from (select model, {expression} as v from ({_counts('model')}))"
    )


ORACLES = {
    "threshold_predict": sql(
        "scored",
        "select sentence_id, model, cast(probability >= 0.5 as int) as predicted_label, "
        "case when probability >= 0.5 then 'positive' else 'negative' end as predicted_sentiment "
        "from scored",
    ),
    "probability_sanity": sql(
        "wide",
        "select source, count(*) as rows, count(*) filter (value is null or isnan(value) or "
        "value / 100.0 < 0 or value / 100.0 > 1) as bad_probabilities, "
        "count(*) filter (label not in (0, 1)) as bad_labels, "
        "2 - count(distinct label) as missing_classes from wide group by source",
    ),
    "logit_to_probability": "select event_id, round(1.0 / (1.0 + exp(-greatest(-80.0, "
    "least(80.0, (value - 50.0) * 2.0)))), 12) as probability, "
    "round(1.0 / (1.0 + exp(-(value - 50.0))), 12) as softmax from events",
    "confusion_matrix": sql(
        "scored",
        "select m.model, g.actual, g.predicted, count(s.sentence_id) as rows "
        "from (select unnest(['a', 'b']) as model) m "
        "cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted) "
        "left join scored s on s.model = m.model and s.label = g.actual "
        "and cast(s.probability >= 0.5 as int) = g.predicted group by all",
    ),
    "threshold_metrics": sql("scored", f"select {_MS}, {_THRESHOLD} from ({_counts(_MS)})"),
    "roc_auc": sql(
        "scored",
        f"select {_MS}, round({_AUC}, 9) as roc_auc from ({_ranking(_MS)}) group by {_MS}",
    ),
    "average_precision": sql(
        "scored",
        f"select {_MS}, round({_AP}, 9) as average_precision from ({_ranking(_MS)}) "
        f"group by {_MS}",
    ),
    "brier_score": sql(
        "scored",
        f"select {_MS}, round(avg((probability - label) * (probability - label)), 9) "
        f"as brier_score from scored group by {_MS}",
    ),
    "log_loss": sql(
        "scored", f"select {_MS}, round(avg({_LOSS}), 9) as log_loss from scored group by {_MS}"
    ),
    "ece": sql("scored", f"select {_MS}, round(ece, 9) as ece from ({_ece(_MS)})"),
    "calibration_curve": sql(
        "scored",
        f"select {_MS}, {_BIN} as bin, count(*) as rows, round(avg(probability), 9) as "
        f"mean_probability, round(avg(label), 9) as positive_rate from scored group by {_MS}, bin",
    ),
    "source_metrics": sql(
        "scored",
        _all_metrics("model, is_overall, source", "sliced"),
        "sliced as (select model, false as is_overall, source, label, probability from scored "
        "union all select model, true, '', label, probability from scored)",
    ),
    "custom_metric": sql(
        "scored",
        f"select {_MS}, 'youden' as metric, round(tp / cast(tp + fn as double) + "
        f"tn / cast(tn + fp as double) - 1, 9) as value from ({_counts(_MS)})",
    ),
    "paired_deltas": sql(
        "scored", f"{_delta('macro_f1', _F1)} union all {_delta('accuracy', _ACCURACY)}"
    ),
    "prediction_alignment": sql(
        "scored",
        """select m.model, e.split, coalesce(g.predicted, 0) as predicted,
             e.expected - coalesce(g.hits, 0) as missing, coalesce(g.extra, 0) as extra,
             coalesce(g.repeated, 0) as repeated
           from (values ('a'), ('b'), ('c')) m(model)
           cross join (select split, count(*) as expected from wide group by split) e
           left join (select model, split, sum(n) as predicted, count(*) filter (known) as hits,
                        count(*) filter (not known) as extra, count(*) filter (n > 1) as repeated
                 from (select p.model, p.split, p.sentence_id, count(*) as n,
                              bool_or(w.id is not null) as known
                       from predicted p left join wide w
                         on cast(w.id as varchar) = p.sentence_id and w.split = p.split
                       group by all) group by model, split) g
             on e.split = g.split and m.model = g.model""",
        """predicted as (
          select model, sentence_id, case when model = 'b' and source = 'view'
            then case split when 'test' then 'validation' else 'test' end else split end as split
          from scored where model = 'a' or source <> 'error'
          union all select model, sentence_id, split from scored
          where model = 'b' and source = 'click'
          union all select 'c', sentence_id, split from scored
          where model = 'a' and split = 'validation')""",
    ),
    "wide_predictions": sql("wide", _WIDE_ROWS),
    "disagreements": sql("wide", f"select * from ({_WIDE_ROWS}) where a_prediction <> b_prediction"),
    "model_comparison": sql(
        "scored",
        "select t.model, 'validation' as selection_split, v.macro_f1 as validation_macro_f1, "
        + ", ".join(f"t.{name} as test_{name}" for name in _RENAMED)
        + ", round(t.raw_f1 - v.raw_f1, 9) as validation_to_test_macro_f1_delta, "
        "t.model as display_name, true as test_macro_f1_bracketed, true as test_accuracy_bracketed "
        "from m t left join m v on t.model = v.model and v.split = 'validation' "
        "where t.split = 'test'",
        "three as (select model, split, label, probability from scored union all "
        "select 'c', split, label, probability from scored where model = 'a' and split = 'test')",
        f"m as (select *, {_F1} as raw_f1 from ({_all_metrics('model, split', 'three')}) "
        f"join ({_counts('model, split', 'three')}) using (model, split))",
    ),
    "model_comparison_ci": sql(
        "scored",
        f"""select t.model, round(v.f1, 9) as validation_macro_f1, round(t.f1, 9) as test_macro_f1,
             round(t.acc, 9) as test_accuracy, case when r.model is not null then 'traditional' end as family,
             r.parameter_count, r.artifact_bytes, case when r.model is not null then 'cpu' end as device,
             case when r.model is not null then false end as pretrained,
             true as test_macro_f1_bracketed, true as test_accuracy_bracketed
           from (select * from f where split = 'test') t
           join (select * from f where split = 'validation') v on t.model = v.model
           left join (select model || '-a' as model, parameter_count, artifact_bytes from runs) r
             on r.model = t.model""",
        "named as (select source || '-' || model as model, split, label, probability from scored)",
        f"f as (select model, split, {_F1} as f1, {_ACCURACY} as acc from ({_counts('model, split', 'named')}))",
        _RUNS,
    ),
    "bootstrap_ci": sql(
        "scored",
        f"""select model, 'macro_f1' as metric, round({_F1}, 9) as point, 1000 as used_iterations,
             null as normal_width, true as brackets from ({_counts('model')})
           union all select model, 'accuracy', round({_ACCURACY}, 9), 1000, true, true from ({_counts('model')})""",
    ),
    "probability_intervals": sql(
        "scored",
        f"""select f.model, m.metric, round(m.point, 9) as point, 1000 as used_iterations,
          round({_NORMAL} * m.sd, 9) as normal_width, case when m.sd is not null then 1.0 end as times_as_wide,
          case when m.sd is not null then true end as centred
        from facts f, lateral (values
          ('roc_auc', auc, sqrt((a2 / pp - auc * auc) / pp + (a3 / nn - auc * auc) / nn)),
          ('average_precision', ap, null),
          ('brier_score', b1 / (pp + nn), sqrt((b2 / (pp + nn) - power(b1 / (pp + nn), 2)) / (pp + nn))),
          ('log_loss', l1 / (pp + nn), sqrt((l2 / (pp + nn) - power(l1 / (pp + nn), 2)) / (pp + nn))),
          ('ece_10_bin', (select e.ece from eces e where e.model = f.model), null)) m(metric, point, sd)""",
        f"""cells as (select model, probability as p, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg,
             -ln(greatest({EPSILON!r}, least(1 - {EPSILON!r}, probability))) as one,
             -ln(greatest({EPSILON!r}, least(1 - {EPSILON!r}, 1 - probability))) as zero
           from scored group by all)""",
        """ranked as (select *, sum(pos) over whole as pp, sum(neg) over whole as nn,
             coalesce(sum(pos) over below, 0) as pb, coalesce(sum(neg) over below, 0) as nb
           from cells window whole as (partition by model),
             below as (partition by model order by p rows between unbounded preceding and 1 preceding))""",
        """facts as (select model, any_value(pp) as pp, any_value(nn) as nn,
             sum(pos * (nb + neg / 2.0)) / any_value(pp * nn) as auc,
             sum(pos * power((nb + neg / 2.0) / nn, 2)) as a2, sum(neg * power((pp - pb - pos / 2.0) / pp, 2)) as a3,
             sum(pos / pp * ((pp - pb) / ((pp - pb) + (nn - nb)))) as ap,
             sum(pos * power(1 - p, 2) + neg * p * p) as b1, sum(pos * power(1 - p, 4) + neg * power(p, 4)) as b2,
             sum(pos * one + neg * zero) as l1, sum(pos * one * one + neg * zero * zero) as l2
           from ranked group by model)""",
        f"eces as ({_ece('model')})",
    ),
    "custom_metric_ci": sql(
        "scored",
        "select model, 'youden' as metric, round(tp / cast(tp + fn as double) + tn / cast(tn + fp as double) - 1, 9) "
        f"as point, 1000 as used_iterations, true as brackets from ({_counts('model')})",
    ),
    "paired_bootstrap": sql(
        "scored",
        "select *, 1000 as used_iterations, 1000 as bootstrap_iterations, true as brackets from "
        f"({_delta('macro_f1', _F1)} union all {_delta('accuracy', _ACCURACY)})",
    ),
    "champion": sql(
        "scored",
        f"select model, round({_F1}, 9) as validation_macro_f1 from ({_counts('model', 'named')}) "
        f"order by {_F1} desc, model limit 1",
        "named as (select source || '-' || model as model, label, probability from scored "
        "where split = 'validation')",
    ),
    "select_candidate": sql(
        "wide",
        "select *, row_number() over (partition by model order by validation_macro_f1 desc, "
        "candidate_index) = 1 as selected from (select model, candidate_index, "
        f"round({_F1}, 6) as validation_macro_f1 "
        f"from ({_counts('model, candidate_index', 'hourly')}))",
        "hourly as (select 'a' as model, hour(ts) as candidate_index, label, p_a as probability "
        "from wide union all select 'b', hour(ts), label, p_b from wide)",
    ),
    "early_stopping": sql(
        "wide",
        """select model, max(epoch) filter (is_best) over (partition by model) as best_epoch,
             max(epoch) over (partition by model) as last_epoch, epoch, validation_macro_f1,
             is_best, since_best
           from placed where epoch <= stop""",
        "daily as (select source as model, day(ts) as epoch, label, p_a as probability from wide)",
        f"history as (select model, epoch, round({_F1}, 6) as validation_macro_f1 "
        f"from ({_counts('model, epoch', 'daily')}))",
        """flagged as (select *, coalesce(validation_macro_f1 > max(validation_macro_f1) over (
             partition by model order by epoch rows between unbounded preceding and 1 preceding)
             + 1e-12, true) as is_best from history)""",
        """runs as (select *, sum(is_best::int) over (partition by model order by epoch) as island
           from flagged)""",
        f"""placed as (select *, cast(since as int) as since_best,
             coalesce(min(epoch) filter (since >= {_PATIENCE}) over (partition by model), 1000)
               as stop
           from (select *, row_number() over (partition by model, island order by epoch) - 1
                   as since from runs))""",
    ),
    "worst_slice": sql(
        "scored",
        f"select model, source, round({_F1}, 9) as macro_f1 from ({_counts(_MS)}) "
        f"order by {_F1}, model, source limit 1",
    ),
    "source_pivot": sql(
        "scored",
        "select model, "
        + ", ".join(f"round(max(v) filter (source = '{t}'), 9) as \"{t}\"" for t in _TYPES)
        + f" from (select {_MS}, {_F1} as v from ({_counts(_MS)})) group by model",
    ),
    "cost_columns": f"with {_RUNS}, {_COSTS} select model, round(train_seconds, 6) as "
    "train_seconds, round(inference_seconds, 6) as inference_seconds, inference_samples, "
    "parameter_count, artifact_bytes, round(inference_ms_per_sample, 6) as "
    "inference_ms_per_sample, round(artifact_mib, 6) as artifact_mib from costs",
    "cost_ratios": f"with {_RUNS}, {_COSTS} select c.model, "
    + ", ".join(
        f"round(c.{name} / greatest(b.{name}, {floor}), 6) as {name}_ratio"
        for name, floor in (
            ("train_seconds", "1e-9"),
            ("inference_ms_per_sample", "1e-9"),
            ("parameter_count", "1"),
            ("artifact_bytes", "1"),
        )
    )
    + " from costs c, (select * from costs where model = 'click') b",
}
