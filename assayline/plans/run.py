"""The whole experiment: prepare, split, fit the rungs, evaluate, write the evidence."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import compare, profile, split, uncertainty
from assayline.operators.dedup import label_conflicts, prepare_checked
from assayline.operators.learn import (
    EMBEDDING_NAME,
    PRETRAINED_NAME,
    TEXT_PARTITION_BYTES,
    TFIDF_NAME,
    EmbeddingSettings,
    Rung,
    candidate_search,
    embedding_rung,
    pretrained_rung,
    save_rung,
)
from assayline.operators.metrics import source_metrics
from assayline.plans.stages import Stages
from assayline.schema import (
    DECISION_THRESHOLD,
    ID,
    LABEL,
    MODEL_RUNS,
    PREDICTIONS,
    SOURCE,
    SPLIT,
)
from assayline.session import fresh_path, materialise, scratch
from assayline.sources import files, tables
from assayline.sources.archives import checked_archives, publish_prepared


@dataclass
class Evaluation:
    """Evidence tables of a run, all lazy but backed by written predictions."""

    champion_model: str
    tables: dict[str, DataFrame]


_RUNG_STAGES = ("search", "history", "predictions", "costs")


def rung_stage(
    stages: Stages, name: str, fit: Callable[[], Rung], rows: DataFrame, samples: int, bundle: str
) -> dict[str, DataFrame]:
    """``predictions`` for the ``samples`` rows, ``costs`` and, where the rung has them, ``search`` and ``history``.

    The rung is saved at ``bundle`` and sized there, and its own scoring is timed by itself. The
    costs are written last: a run that finds them fits nothing.
    """
    spark, found = rows.sparkSession, {}
    if not stages.has(f"{name}-costs"):
        for kind in _RUNG_STAGES:  # of a fit that broke off; a new one may differ in its last bits
            stages.drop(f"{name}-{kind}")
        rung = fit()
        for kind, table in (("search", rung.search), ("history", rung.history)):
            if table is not None:
                stages.table(f"{name}-{kind}", lambda table=table: table)
        size = files.artifact_bytes(spark, save_rung(rung, bundle, spark)).first()["artifact_bytes"]
        scored = rung.score(rows).select(F.lit(name).alias("model"), SPLIT, ID, "probability")
        clock = time.perf_counter()
        stages.table(f"{name}-predictions", lambda: scored.select(*PREDICTIONS.names))
        spent = time.perf_counter() - clock
        parameters = int(rung.parameter_count)
        cost = (
            name, rung.family, float(rung.train_seconds), spent, samples, parameters, parameters,
            int(size), rung.best_epoch, rung.metadata,
        )
        stages.table(f"{name}-costs", lambda: spark.createDataFrame([cost], MODEL_RUNS))
    for kind in _RUNG_STAGES:
        if stages.has(f"{name}-{kind}"):
            found[kind] = spark.read.parquet(stages.path(f"{name}-{kind}"))
    return found


def evaluate(
    predictions: DataFrame,
    assigned: DataFrame,
    runs: DataFrame,
    resamples: int,
    seed: int,
    baseline: str = compare.BASELINE,
) -> Evaluation:
    """Common evaluation after validation-only selection."""
    compare.require_unique_models(runs)
    held_out = assigned.where(F.col(SPLIT).isin("validation", "test"))
    compare.require_aligned(predictions, held_out.select(ID, SPLIT))
    scored = materialise(
        predictions.join(held_out.select(ID, SOURCE, LABEL), ID), "scored"
    )
    test = scored.where(F.col(SPLIT) == "test")
    models = sorted(r["model"] for r in runs.select("model").collect())
    comparison = materialise(
        compare.model_comparison(scored, runs, resamples, seed), "comparison"
    )
    compare.require_complete(comparison)
    best = compare.champion(comparison).first()["model"]
    wide = compare.wide_predictions(test, models)
    slices = source_metrics(test)
    evidence = {
        "model_comparison": comparison.orderBy(F.col("validation_macro_f1").desc(), "model"),
        "test_predictions": wide.orderBy(ID),
        "model_disagreements": compare.disagreements(wide, models).orderBy(ID),
        "source_metrics": slices.where(~F.col("is_overall")).drop("is_overall"),
        "cost_ratios": compare.cost_ratios(comparison, baseline),
    }
    if baseline in models and len(models) > 1:
        cells = uncertainty.joint_cells(wide, models, baseline)
        evidence["paired_deltas"] = uncertainty.paired_bootstrap(
            cells, iterations=resamples, seed=seed
        )
    return Evaluation(best, evidence)


def metrics_report(comparison: DataFrame, champion_model: str, resamples: int) -> DataFrame:
    """One nested row: the champion, how it was chosen, and every model's metrics by name."""
    values = [c for c, kind in comparison.dtypes if kind == "double"]
    named = F.create_map(*[cell for c in values for cell in (F.lit(c), F.col(c))])
    return comparison.groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("model", named))).alias("models")
    ).select(
        F.lit(champion_model).alias("champion_model"),
        F.lit("highest validation macro-F1, then the model name").alias("selection_rule"),
        F.lit(DECISION_THRESHOLD).alias("decision_threshold"),
        F.lit(resamples).alias("bootstrap_iterations"),
        "models",
    )


def run_benchmark(
    labelled: DataFrame,
    order: list[str],
    folder: str | None = None,
    vectors: DataFrame | None = None,
    vector_column: str = "embedding",
    embedding: EmbeddingSettings | None = None,
    split_config: split.SplitConfig | None = None,
    max_terms: int | None = None,
    resamples: int = 1_000,
    seed: int = 42,
    assignments: DataFrame | None = None,
    may_conflict: bool = False,
) -> Evaluation:
    """Labelled rows to evidence tables; with ``folder`` they are also published there.

    ``vectors`` maps the prepared sentence ids to given vectors and adds the third rung.
    Saved ``assignments`` take the place of a new split. With ``may_conflict`` equal texts may have several labels: the first
    stands, and the evidence lists them as ``label_conflicts``. The prepared rows, the assigned rows and the predictions are written once each and
    read by everything after them.
    """
    settings = RunSettings(embedding, split_config, max_terms, resamples, seed)
    spark = labelled.sparkSession
    stages = Stages(spark, fresh_path(spark, "run"))
    raw_rows = labelled.count()
    prepared = stages.table("prepared", lambda: prepare_checked(labelled, order, may_conflict=may_conflict))
    conflicts = stages.table("conflicts", lambda: label_conflicts(labelled)) if may_conflict else None
    return run_prepared(
        stages, prepared, raw_rows, settings, folder, vectors, vector_column, assignments, conflicts=conflicts
    )


class RunSettings:
    """How a run splits, fits and resamples; what is None takes its default."""

    def __init__(
        self,
        embedding: EmbeddingSettings | None = None,
        split_config: split.SplitConfig | None = None,
        max_terms: int | None = None,
        resamples: int = 1_000,
        seed: int = 42,
    ):
        self.embedding = embedding or EmbeddingSettings()
        self.split_config = split_config or split.SplitConfig(seed=seed)
        self.max_terms, self.resamples, self.seed = max_terms, resamples, seed

    def named(self) -> dict[str, object]:
        return {
            **vars(self.embedding), **vars(self.split_config),
            "max_terms": self.max_terms, "resamples": self.resamples, "run_seed": self.seed,
        }


def run_prepared(
    stages: Stages,
    prepared: DataFrame,
    raw_rows: int,
    settings: RunSettings,
    folder: str | None = None,
    vectors: DataFrame | None = None,
    vector_column: str = "embedding",
    assignments: DataFrame | None = None,
    inputs: DataFrame | None = None,
    conflicts: DataFrame | None = None,
) -> Evaluation:
    """The run after its rows are prepared. ``inputs`` are checksums of what they came from, ``conflicts`` the
    texts with several labels, if these are allowed."""
    started = time.perf_counter()

    def divided() -> DataFrame:
        if assignments is None:
            return split.create_splits(prepared, settings.split_config)
        rows = split.apply_split(prepared, assignments)
        split.require_no_leakage(rows)
        return rows

    assigned = stages.table("assigned", divided, TEXT_PARTITION_BYTES)
    scored_rows = assigned
    fits: dict[str, Callable[[], Rung]] = {
        TFIDF_NAME: lambda: candidate_search(assigned, settings.max_terms),
        EMBEDDING_NAME: lambda: embedding_rung(assigned, settings.embedding, settings.seed),
    }
    if vectors is not None:
        scored_rows = stages.table("with-vectors", lambda: assigned.join(vectors, ID))
        fits[PRETRAINED_NAME] = lambda: pretrained_rung(scored_rows, vector_column)
    bundles = f"{folder}/models" if folder is not None else stages.path("models")
    held_out = scored_rows.where(F.col(SPLIT).isin("validation", "test"))
    samples = held_out.count()
    rungs = {
        name: rung_stage(stages, name, fit, held_out, samples, f"{bundles}/{name}") for name, fit in fits.items()
    }
    stacked = {
        kind: reduce(DataFrame.unionByName, [found[kind] for found in rungs.values()])
        for kind in ("predictions", "costs")
    }
    evaluation = evaluate(stacked["predictions"], assigned, stacked["costs"], settings.resamples, settings.seed)
    evidence = evaluation.tables
    evidence["dataset_by_source"] = profile.source_profile(prepared)
    evidence["split_distribution"] = profile.split_distribution(assigned)
    for name, found in rungs.items():
        evidence |= {f"{name}_{kind}": found[kind] for kind in ("search", "history") if kind in found}
    config = settings.named()
    if conflicts is not None:
        evidence["label_conflicts"] = conflicts.orderBy(ID)
    if inputs is not None:
        evidence["input_checksums"] = inputs.orderBy("path")
        config["input_digest"] = tables.table_digest(inputs).first()["digest"]
    assignments = assigned.select(ID, SPLIT)
    manifest = tables.run_manifest(prepared, assignments, raw_rows, config, evaluation.champion_model)
    summary = profile.dataset_summary(raw_rows, assigned)
    report = prepared.sparkSession.createDataFrame(
        [
            (
                evaluation.champion_model,
                ",".join(rungs),
                raw_rows,
                time.perf_counter() - started,
            )
        ],
        "champion_model string, models_compared string, raw_rows bigint, elapsed_seconds double",
    )
    metrics = metrics_report(evidence["model_comparison"], evaluation.champion_model, settings.resamples)
    nested = {"run_manifest": manifest, "dataset_summary": summary, "run_summary": report, "metrics": metrics}
    if folder is not None:
        tables.write_evidence(evidence, folder)
        tables.publish(assignments.orderBy(ID), f"{folder}/assignments")
        for name, rows in nested.items():
            tables.write_json(rows, f"{folder}/{name}")
    evidence |= nested
    return evaluation


def published_evidence(spark: SparkSession, evaluation: Evaluation, folder: str) -> Evaluation:
    """The same tables, read from where the run published them."""
    found = {}
    for name, rows in evaluation.tables.items():
        nested = name in ("run_manifest", "dataset_summary", "run_summary", "metrics")
        place = f"{folder}/{name}"
        found[name] = (
            spark.read.schema(rows.schema).json(place) if nested
            else tables.read_table(spark, place, rows.schema, "csv")
        )
    return Evaluation(evaluation.champion_model, found)


def run_archives(
    spark: SparkSession,
    path: str | list[str],
    sources: dict[str, str],
    folder: str,
    manifest: DataFrame | None = None,
    raw_rows: int | None = None,
    prepared_rows: int | None = None,
    pattern: str | None = None,
    vectors: Callable[[DataFrame], DataFrame] | None = None,
    vector_column: str = "embedding",
    settings: RunSettings | None = None,
) -> Evaluation:
    """Stored archives to published evidence below ``folder``; called again after a crash, it goes on.

    The arguments up to ``pattern`` are those of ``checked_archives``. ``vectors`` takes the
    prepared rows and returns ``(sentence_id, vector_column)``. Stages lie in ``folder`` under a digest of the
    archives' checksums, the manifest and all other arguments: whatever differs starts anew. The caller answers for ``vectors`` being the same again. Once all is published, the stages
    and everything else the run wrote on its way are deleted; what it returns reads the published tables.
    """
    settings = settings or RunSettings()
    folder = folder.rstrip("/")
    chosen = {
        **settings.named(), "sources": list(sources.items()), "rows": (raw_rows, prepared_rows),
        "vectors": vectors is not None and vector_column,
        "manifest": manifest is not None and tables.table_digest(manifest).first()["digest"],
    }
    stored = tables.table_digest(files.stored_checksums(spark, path, pattern)).first()["digest"]
    identity = f"{stored}|{sorted(map(str, chosen.items()))}"
    stages = Stages(spark, f"{folder}/stages-{hashlib.sha256(identity.encode()).hexdigest()[:32]}")
    with scratch(spark, stages.folder):  # a killed run's intermediates go with the stages
        if not stages.has("prepared"):
            found = checked_archives(spark, path, sources, manifest, raw_rows, prepared_rows, pattern)
            stages.table("checksums", lambda: found.checksums)
            stages.table("raw-rows", lambda: spark.createDataFrame([(found.raw_rows,)], "rows bigint"))
            publish_prepared(found.rows, stages.path("prepared"), sources)
            stages.computed.append("prepared")
        prepared, checksums, counted = (
            spark.read.parquet(stages.path(name)) for name in ("prepared", "checksums", "raw-rows")
        )
        given = vectors(prepared) if vectors is not None else None
        evaluation = run_prepared(
            stages, prepared, counted.first()["rows"], settings, folder, given, vector_column, inputs=checksums
        )
        published = published_evidence(spark, evaluation, folder)
    stages.clear()
    return published
