"""Distributed classifiers with validation-only selection.

Three rungs: TF-IDF + logistic regression over nine candidates, word embeddings learned on
the train rows with a small network on top, and logistic regression on given vectors.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StandardScaler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.tokens import RESERVED_IDS
from assayline.operators.compare import early_stopping, select_candidate
from assayline.operators.features import BLOCKS, REGULARISATION, encode_text, vocabulary
from assayline.operators.metrics import threshold_metrics
from assayline.operators.quality import require_splits, validate_splits
from assayline.operators.solver import fit_designs
from assayline.operators.terms import (
    BLOCK_KINDS, INTERCEPT, dealt_weights, design_rows, document_frequencies, feature_numbers, margins, term_store, term_table,
)
from assayline.schema import HISTORY, ID, LABEL, SPLIT, TEXT, IntegrityError
from assayline.session import materialise

# Names and families of the rungs, and the solver's iteration limit.
TFIDF_NAME = "tfidf_logistic_regression"
EMBEDDING_NAME = "embedding_network"
PRETRAINED_NAME = "pretrained_vectors"
FAMILIES = {
    TFIDF_NAME: "traditional",
    EMBEDDING_NAME: "deep_learning_from_scratch",
    PRETRAINED_NAME: "pretrained_vectors",
}
MAX_ITERATIONS = 2_000
# Fixed value: stopping tolerance, relative to the gradient at the start.
SOLVER_TOLERANCE = 1e-4
# Written bytes of training vectors per partition of an iterative fit.
FIT_PARTITION_BYTES = 4 * 1024 * 1024
# Entries of all designs in a block of a fit's rows, about: what a task holds.
FIT_ENTRIES = 8_000_000
# The same as bytes above for texts, which cost more work per byte.
TEXT_PARTITION_BYTES = 512 * 1024

FEATURES = "features"


def _probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


@dataclass
class TermModel:
    """A fitted TF-IDF logistic regression: a written table of terms, their idf and weights.

    ``weights`` has one weight for each of ``intercepts``. Rows are scored where they are.
    """

    representation: str
    table: DataFrame  # kind, key, idf, alone, joint, weights
    intercepts: list[float]

    def kinds(self) -> str:
        return "".join(BLOCK_KINDS[self.representation])

    def probabilities(self, store: DataFrame, out: str) -> DataFrame:
        """Adds an array of probabilities, one for each intercept, to rows of a term store."""
        with_margins = margins(store, self.table, self.representation, self.intercepts, out)
        return with_margins.withColumn(out, F.transform(out, _probability))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``."""
        store = term_store(df, df.columns, self.kinds())
        scored = self.probabilities(store, "probability").withColumn("probability", F.col("probability")[0])
        return scored.select(*df.columns, "probability")

    def only(self, place: int) -> TermModel:
        """The model of one of the intercepts."""
        table = self.table.withColumn("weights", F.array(F.col("weights")[place]))
        return TermModel(self.representation, materialise(table, "model"), [self.intercepts[place]])


def fit_term_space(
    train: DataFrame, kinds: str = "ubc", max_terms: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The written term store of train rows (with label) and its term table."""
    store = materialise(term_store(train, [ID, LABEL], kinds), "term-store")
    return store, term_table(document_frequencies(store, kinds), store.count(), max_terms)


def _dealt_by_entries(store: DataFrame, representations: list[str]) -> DataFrame:
    """The rows of a store, dealt out further where the partitions of a fit would exceed ``FIT_ENTRIES``."""
    kinds = [kind for r in representations for block in BLOCK_KINDS[r] for kind in block]
    sizes = sum((F.size(f"{kind}_keys") for kind in kinds), F.lit(0))
    entries = store.agg(F.sum(sizes.cast("bigint"))).first()[0] or 0
    parts = -(-entries // FIT_ENTRIES)
    return store.repartition(parts) if parts > store.sparkSession.sparkContext.defaultParallelism else store


def fit_term_models(
    store: DataFrame,
    table: DataFrame,
    representations: list[str],
    strengths: list[float],
    tolerance: float = SOLVER_TOLERANCE,
    whole: bool = False,
) -> dict[str, TermModel]:
    """One model per representation, with a weight and an intercept for each strength; all are
    fitted together, sharing every pass over the store.

    ``whole`` says that the table counts every term of this very store: terms of one row are then one
    feature of the fit, which gives the same weights (``design_rows``).
    """
    single_idf = math.log((1 + store.count()) / 2) + 1.0 if whole else None
    rows = design_rows(store, table, representations, LABEL, single_idf)
    dealt = design_rows(_dealt_by_entries(store, representations), table, representations, LABEL, single_idf)
    fitting = dealt.select("design", "target", "keys", "values")
    weights, _ = fit_designs(fitting, representations, strengths, tolerance, MAX_ITERATIONS)
    intercepts = {r["design"]: list(r["weights"]) for r in weights.where(F.col("key") == INTERCEPT).collect()}
    models = {}
    for name in representations:
        marked = table.where(F.col("alone" if name == "word_unigram" else "joint")).where(
            F.col("kind").isin(*"".join(BLOCK_KINDS[name]))
        )
        own = weights.where(F.col("design") == name).drop("design")
        if whole:
            rare = dealt_weights(rows.where(F.col("design") == name), weights).drop("design")
            common = marked.where("df > 1").join(own, "key")
            fitted = common.unionByName(marked.where("df = 1").join(rare, "key"))
        else:
            fitted = marked.join(own, "key")
        models[name] = TermModel(name, materialise(fitted, "model"), intercepts[name])
    return models


@dataclass
class VectorModel:
    """Weights of given vectors, the last for a constant; as many as the vectors are wide."""

    coefficients: list[float]
    column: str = ""

    def margin(self, values: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(F.concat(values, F.array(F.lit(1.0))), weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    def score(self, df: DataFrame) -> DataFrame:
        values = F.transform(F.col(self.column), lambda x: x.cast("double"))
        return df.withColumn("probability", _probability(self.margin(values)))


def fit_vectors(
    train: DataFrame, column: str, strengths: list[float], tolerance: float = SOLVER_TOLERANCE
) -> dict[float, VectorModel]:
    """Logistic regressions on an array column minimising ``|w|^2 / 2 + C * sum(log loss)``, one per
    C; the constant's weight is regularised like the others."""
    values = F.concat(F.transform(column, lambda x: x.cast("double")), F.array(F.lit(1.0)))
    rows = train.select(F.lit("vectors").alias("design"), F.col(LABEL).cast("double").alias("target"), values.alias("values"))
    placed = F.transform("values", lambda x, i: i.cast("bigint"))
    weights, _ = fit_designs(
        rows.select("design", "target", placed.alias("keys"), "values"), ["vectors"], strengths, tolerance, MAX_ITERATIONS
    )
    found = weights.orderBy("key").collect()  # the vectors' width
    return {c: VectorModel([r["weights"][j] for r in found], column) for j, c in enumerate(strengths)}


def positive_probability(scored: DataFrame, out: str = "probability") -> DataFrame:
    """Replace the classifier's vector by its class-1 entry."""
    value = F.get(vector_to_array("probability"), F.lit(1))
    dropped = scored.drop("rawPrediction", "prediction")
    return dropped.withColumn("_p", value).drop("probability").withColumnRenamed("_p", out)


def _macro_f1(scored: DataFrame) -> float:
    return float(threshold_metrics(scored, []).first()["macro_f1"])


@dataclass
class Rung:
    """One fitted model: what scores with it, what it cost, how it was selected."""

    name: str
    model: object
    train_seconds: float
    parameter_count: int
    vectoriser: object = None
    best_epoch: int | None = None
    history: DataFrame | None = None
    search: DataFrame | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def family(self) -> str:
        return FAMILIES[self.name]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``; its columns are otherwise kept."""
        if self.vectoriser is None:
            return self.model.score(df)
        prepared = self.vectoriser.transform(df)
        return positive_probability(self.model.transform(prepared)).select(*df.columns, "probability")


def candidate_specs() -> list[tuple[int, str, str, float]]:
    """``(index, name, representation, C)`` of the nine candidates."""
    pairs = [(r, c) for r in BLOCKS for c in REGULARISATION]
    return [(i, f"{r}_c{c:g}", r, c) for i, (r, c) in enumerate(pairs)]


_SEARCH = (
    "candidate_index int, candidate string, representation string, C double, "
    "validation_macro_f1 double, feature_count bigint, fit_seconds double, trained_rows string"
)


def _validation_scores(scored: DataFrame, names: list[str]) -> dict[str, float]:
    """Macro-F1 of each candidate from ``(label, probabilities)``, candidates in the order of the array."""
    each = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col("probabilities")[i].alias("probability")) for i, n in enumerate(names)])
    rows = threshold_metrics(scored.select(LABEL, F.inline(each)), ["candidate"]).collect()
    return {r["candidate"]: float(r["macro_f1"]) for r in rows}


def candidate_search(
    assigned: DataFrame, max_terms: int | None = None, tolerance: float = SOLVER_TOLERANCE
) -> Rung:
    """Fit every candidate on train, score validation, keep the best; test rows are not read.

    Every text is cut once, into one written term store; representations are selections of it. All
    nine candidates are fitted together and scored in one pass over the validation rows.
    ``fit_seconds`` of a candidate is its share: a ninth of the joint fit and its score's pass.
    """
    require_splits(validate_splits(assigned))
    started = time.perf_counter()
    rows = assigned.where(F.col(SPLIT).isin("train", "validation")).select(ID, TEXT, LABEL, SPLIT)
    store = materialise(term_store(rows, [ID, LABEL, SPLIT]), "term-store", FIT_PARTITION_BYTES)
    train = store.where(F.col(SPLIT) == "train")
    table = term_table(document_frequencies(train), train.count(), max_terms)
    models = fit_term_models(train, table, list(BLOCKS), list(REGULARISATION), tolerance, max_terms is None)
    scored = store.where(F.col(SPLIT) == "validation")
    for name, model in models.items():
        scored = model.probabilities(scored, f"_{name}")
    specs = candidate_specs()
    joined = F.concat(*[F.col(f"_{name}") for name in models]).alias("probabilities")
    scores = _validation_scores(scored.select(LABEL, joined), [name for _, name, _, _ in specs])
    seconds = (time.perf_counter() - started) / len(specs)
    counts = feature_numbers(table)
    results = [
        (index, name, representation, c, scores[name], counts[representation], seconds, "train_only")
        for index, name, representation, c in specs
    ]
    search = select_candidate(assigned.sparkSession.createDataFrame(results, _SEARCH))
    chosen = search.where("selected").first()
    representation = chosen["representation"]
    return Rung(
        TFIDF_NAME,
        models[representation].only(list(REGULARISATION).index(chosen["C"])),
        time.perf_counter() - started,
        counts[representation] + 1,
        search=search,
        metadata={
            "selected_candidate": chosen["candidate"],
            "selection_metric": "validation_macro_f1",
            "validation_macro_f1": repr(chosen["validation_macro_f1"]),
            "trained_on": "train_only",
            "feature_count": str(counts[representation]),
            "candidate_count": str(len(results)),
        },
    )


@dataclass(frozen=True)
class EmbeddingSettings:
    """Settings of the from-scratch rung; each is used. ``max_tokens`` bounds a text, if asked."""

    # Epochs, patience and vocabulary size.
    epochs: int = 18
    patience: int = 4
    vocabulary_size: int = 12_000
    max_tokens: int | None = None
    vector_size: int = 64
    hidden: int = 32
    steps_per_epoch: int = 15


@dataclass
class Pooler:
    """Standardised mean of learned token vectors as the feature column.

    Texts are encoded by the train vocabulary (unknown tokens share one vector), whole unless bounded;
    ``words`` has at most the configured vocabulary's size.
    """

    words: list[tuple[str, int]]
    max_tokens: int | None
    model: object  # word vectors, then the scaler

    def encoded(self, df: DataFrame) -> DataFrame:
        vocab = df.sparkSession.createDataFrame(self.words, "token string, token_id int")
        ids = encode_text(df, vocab, self.max_tokens)
        return ids.withColumn("tokens", F.col("token_ids").cast("array<string>")).drop("token_ids")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.encoded(df)).drop("tokens", "_mean")


# Rows per partition of the from-scratch fit: the rows alone decide the partitions, not the cores. Learning the
# words is one long pass over a partition, by one core; a step of the network is short, and dearer by its tasks.
WORD_ROWS_PER_PARTITION = 8_192
ROWS_PER_PARTITION = 50_000


def _fixed_order(df: DataFrame, rows: int, per_partition: int) -> DataFrame:
    """The same rows in the same partitions and order on any number of cores."""
    return df.repartition(1 + rows // per_partition, ID).sortWithinPartitions(ID)


def _by_epochs(
    name: str,
    train: DataFrame,
    validation: DataFrame,
    fit_epoch,
    epochs: int,
    patience: int,
) -> tuple[object, int, DataFrame]:
    """Call ``fit_epoch(previous)`` until the stopping rule says so; best model, epoch, history."""
    spark = train.sparkSession
    rows, models, model = [], [], None
    for epoch in range(1, epochs + 1):
        model, loss = fit_epoch(model)
        models.append(model)
        score = _macro_f1(positive_probability(model.transform(validation)))
        rows.append((name, epoch, loss, None, score))
        history = spark.createDataFrame(rows, HISTORY)
        replay = early_stopping(history, patience).orderBy(F.col("epoch").desc()).first()
        if replay["since_best"] >= patience:
            break
    return models[replay["best_epoch"] - 1], replay["best_epoch"], history


def embedding_rung(
    assigned: DataFrame, settings: EmbeddingSettings | None = None, seed: int = 42
) -> Rung:
    """Token vectors from the train rows only, mean-pooled, with a one-layer network on top.

    An epoch is a few optimiser steps from the previous weights; the epoch with the best
    validation score is kept. Train texts are encoded once, into a written table of ids, and pooled once.
    """
    settings = settings or EmbeddingSettings()
    require_splits(validate_splits(assigned))
    started = time.perf_counter()
    train = assigned.where(F.col(SPLIT) == "train").select(ID, TEXT, LABEL)
    validation = assigned.where(F.col(SPLIT) == "validation").select(ID, TEXT, LABEL)
    rows = train.count()
    vocab = vocabulary(train, settings.vocabulary_size).select("token", "token_id")
    words = [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()]  # bounded by the setting
    pooler = Pooler(words, settings.max_tokens, None)
    label = F.col(LABEL).cast("double").alias(LABEL)
    encoded = materialise(pooler.encoded(train).select(ID, label, "tokens"), "encoded-train")
    vectors = Word2Vec(
        vectorSize=settings.vector_size,
        minCount=1,
        inputCol="tokens",
        outputCol="_mean",
        seed=seed,
        maxIter=1,
        numPartitions=1 + rows // WORD_ROWS_PER_PARTITION,
    ).fit(_fixed_order(encoded, rows, WORD_ROWS_PER_PARTITION))
    means = materialise(vectors.transform(encoded).select(ID, LABEL, "_mean"), "pooled-train")
    means = _fixed_order(means, rows, ROWS_PER_PARTITION)
    scaler = StandardScaler(inputCol="_mean", outputCol=FEATURES, withMean=True).fit(means)
    pooler.model = PipelineModel([vectors, scaler])
    fit_on = scaler.transform(means).select(ID, LABEL, FEATURES)
    check_on = materialise(pooler.transform(validation).select(LABEL, FEATURES), "pooled-validation")

    def fit_epoch(previous: MultilayerPerceptronClassificationModel | None):
        network = MultilayerPerceptronClassifier(
            layers=[settings.vector_size, settings.hidden, 2],
            featuresCol=FEATURES,
            labelCol=LABEL,
            maxIter=settings.steps_per_epoch,
            seed=seed,
        )
        if previous is not None:
            network = network.setInitialWeights(previous.weights)
        model = network.fit(fit_on)
        return model, float(model.summary().objectiveHistory[-1])

    best, best_epoch, history = _by_epochs(
        EMBEDDING_NAME, fit_on, check_on, fit_epoch, settings.epochs, settings.patience
    )
    known = vectors.getVectors().count()
    return Rung(
        EMBEDDING_NAME,
        best,
        time.perf_counter() - started,
        known * settings.vector_size + int(best.weights.size),
        pooler,
        best_epoch=best_epoch,
        history=history,
        metadata={
            "trained_on": "train_only",
            "train_rows": str(rows),
            "vocabulary": str(len(words) + RESERVED_IDS),
        },
    )


def pretrained_rung(
    assigned: DataFrame, column: str = "embedding", tolerance: float = SOLVER_TOLERANCE
) -> Rung:
    """Logistic regression on vectors someone else trained; strength chosen on validation."""
    started = time.perf_counter()
    train = assigned.where(F.col(SPLIT) == "train").select(LABEL, column)
    fit_on = materialise(train, "vectors-train", FIT_PARTITION_BYTES)
    models = fit_vectors(fit_on, column, list(REGULARISATION), tolerance)
    validation = assigned.where(F.col(SPLIT) == "validation").select(LABEL, column)
    names = [f"vectors_c{c:g}" for c in REGULARISATION]
    each = F.array(*[_probability(m.margin(F.transform(column, lambda x: x.cast("double")))) for m in models.values()])
    scores = _validation_scores(validation.select(LABEL, each.alias("probabilities")), names)
    seconds = (time.perf_counter() - started) / len(names)
    results = [
        (index, name, "vectors", c, scores[name], len(models[c].coefficients) - 1, seconds, "train_only")
        for index, (name, c) in enumerate(zip(names, REGULARISATION))
    ]
    search = select_candidate(assigned.sparkSession.createDataFrame(results, _SEARCH))
    chosen = search.where("selected").first()
    best = models[chosen["C"]]
    return Rung(
        PRETRAINED_NAME,
        best,
        time.perf_counter() - started,
        len(best.coefficients),
        search=search,
        metadata={
            "selected_candidate": chosen["candidate"],
            "trained_on": "train_only",
            "pretraining_compute_included": "false",
        },
    )


def save_rung(rung: Rung, path: str, spark: SparkSession) -> str:
    """Model, term space and audit metadata below ``path``."""
    meta = {
        "model_name": rung.name,
        "family": rung.family,
        "parameter_count": rung.parameter_count,
        "train_seconds": rung.train_seconds,
        "best_epoch": rung.best_epoch,
        **rung.metadata,
    }
    if isinstance(rung.model, TermModel):
        meta["representation"] = rung.model.representation
        meta["intercepts"] = rung.model.intercepts
        rung.model.table.write.mode("overwrite").parquet(f"{path}/terms")
    elif isinstance(rung.model, VectorModel):
        meta["vector_column"] = rung.model.column
        meta["coefficients"] = rung.model.coefficients
    else:
        PipelineModel([rung.model]).write().overwrite().save(f"{path}/model")
        rung.vectoriser.model.write().overwrite().save(f"{path}/vectors")
        meta["max_tokens"] = rung.vectoriser.max_tokens
        spark.createDataFrame(rung.vectoriser.words, "token string, token_id int").write.mode(
            "overwrite").parquet(f"{path}/words")
    line = json.dumps(meta, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/metadata"
    )
    return path


def load_rung(path: str, expected_name: str, spark: SparkSession) -> Rung:
    """Load a bundle and insist on its model name."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if meta.get("model_name") != expected_name:
        raise IntegrityError(f"{path} holds {meta.get('model_name')!r}, not {expected_name!r}")
    model: object
    vectoriser = None
    if "representation" in meta:
        model = TermModel(meta["representation"], spark.read.parquet(f"{path}/terms"), meta["intercepts"])
    elif "coefficients" in meta:
        model = VectorModel(meta["coefficients"], meta["vector_column"])
    else:
        model = PipelineModel.load(f"{path}/model").stages[0]
        table = spark.read.parquet(f"{path}/words").orderBy("token_id").collect()
        words = [(r.token, r.token_id) for r in table]
        vectoriser = Pooler(words, meta["max_tokens"], PipelineModel.load(f"{path}/vectors"))
    return Rung(
        expected_name,
        model,
        meta["train_seconds"],
        meta["parameter_count"],
        vectoriser,
        best_epoch=meta["best_epoch"],
    )
