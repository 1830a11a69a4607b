"""Queries that fit models and score with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.tokens import with_word_ngrams
from assayline.operators import learn, score
from assayline.operators.split import apply_split, stratified_split
from assayline.operators.terms import with_idf, word_key
from assayline.plans import text_queries, views
from assayline.plans.data_queries import ARCHIVE_SOURCES, FILE_ROWS, stored_archives
from assayline.plans.run import run_archives as run_stored
from assayline.plans.run import run_benchmark as run
from assayline.schema import ID, LABEL, SPLIT, SPLIT_NAMES
from assayline.session import fresh_path, materialise, table
from assayline.sources.tables import publish


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a split over them."""
    rows = views.embedding_labels(spark, folder)
    assigned = apply_split(rows, stratified_split(rows), check=False)
    return materialise(assigned, "vectors")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(views.assigned(spark, folder), "assigned", learn.TEXT_PARTITION_BYTES)


def logistic_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the regularised fit of the event labels on the event value, intercept last."""
    rows = views.scored_wide(spark, folder)
    vectors = rows.select("label", F.array(F.col("value") / 100).alias("value"))
    model = learn.fit_vectors(vectors, "value", [1.0], tolerance=1e-9)[1.0]
    weights = [(i, round(float(w), 6)) for i, w in enumerate(model.coefficients)]
    return spark.createDataFrame(weights, "place int, weight double")


def candidate_search(spark: SparkSession, folder: str) -> DataFrame:
    """The nine candidates; ``by_rule`` says whether the marked one is the best by the stated rule."""
    search = learn.candidate_search(_documents(spark, folder)).search
    return _by_rule(search).select(
        "candidate_index", "candidate", "representation", "C", "feature_count", "trained_rows", "by_rule"
    )


def _by_rule(search: DataFrame) -> DataFrame:
    """Checks the selection against a plain reading of its rule: the highest score, then the
    lowest index."""
    scores = {r.candidate_index: (-r.validation_macro_f1, r.candidate_index) for r in search.collect()}
    best = min(scores, key=scores.get)  # a handful of candidates
    rule = F.col("selected") == (F.col("candidate_index") == best)
    return search.withColumn("by_rule", rule & F.col("validation_macro_f1").between(0, 1))


def embedding_rung(spark: SparkSession, folder: str) -> DataFrame:
    """The rung's vocabulary and train rows, and whether it kept the epoch and stopped as stated."""
    settings = learn.EmbeddingSettings()
    rung = learn.embedding_rung(_documents(spark, folder), settings)
    scores = [r.validation_macro_f1 for r in rung.history.orderBy("epoch").collect()]  # one per epoch
    first_best = 1 + max(range(len(scores)), key=lambda e: (scores[e], -e))
    ended = len(scores) == min(settings.epochs, rung.best_epoch + settings.patience)
    row = (int(rung.metadata["vocabulary"]), int(rung.metadata["train_rows"]), rung.best_epoch == first_best, ended)
    return spark.createDataFrame([row], "vocabulary bigint, train_rows bigint, best_by_rule boolean, ended_by_rule boolean")


def pretrained_rung(spark: SparkSession, folder: str) -> DataFrame:
    search = learn.pretrained_rung(_vectors(spark, folder)).search
    return _by_rule(search).select("candidate_index", "candidate", "C", "feature_count", "trained_rows", "by_rule")


#: Intercept and weights that SQL can state as well.
_INTERCEPT = 0.25


def _stated_model(train: DataFrame) -> learn.TermModel:
    """The words and pairs of the train rows, with idf from them and weights stated by a formula."""
    cut = with_word_ngrams(train.select("text"), "text", "terms", 1, 2)
    terms = cut.select(F.explode_outer(F.array_distinct("terms")).alias("term")).where("term is not null")
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = (F.pmod(F.length("term") * 5 + F.instr("term", "e"), F.lit(9)) - 4) / 2.0
    marked = counted.select(
        F.when(F.contains("term", F.lit(" ")), "b").otherwise("u").alias("kind"), word_key(F.col("term")).alias("key"),
        "df", (~F.contains("term", F.lit(" "))).alias("alone"), F.lit(True).alias("joint"), F.array(weight).alias("weights"),
    )
    return learn.TermModel("word_bigram", materialise(with_idf(marked, train.count()), "stated"), [_INTERCEPT])


def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A model over the terms of the train split, of stated weights, scores every chat turn."""
    model = _stated_model(_documents(spark, folder).where(F.col(SPLIT) == "train"))
    rung = learn.Rung(learn.TFIDF_NAME, model, 0.0, model.table.count() + 1)
    return views.rounded(score.score_batch(views.chat_input(spark, folder), rung), 6)


def score_file(spark: SparkSession, folder: str) -> DataFrame:
    """The chat turns as CSV, scored into a CSV table by the stated model, saved and named."""
    model = _stated_model(_documents(spark, folder).where(F.col(SPLIT) == "train"))
    rung = learn.Rung(learn.TFIDF_NAME, model, 0.0, model.table.count() + 1)
    saved = learn.save_rung(rung, fresh_path(spark, "model"), spark)
    source = publish(views.chat_input(spark, folder), fresh_path(spark, "turns"), "csv")
    target = score.score_file(spark, source, fresh_path(spark, "scores"), saved, rung.name)
    return views.rounded(score.read_scores(spark, target), 6)


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the selected model, saved and reloaded, next to the original's."""
    assigned = _documents(spark, folder)
    rung = learn.candidate_search(assigned)
    path = fresh_path(spark, "model")
    learn.save_rung(rung, path, spark)
    again = learn.load_rung(path, learn.TFIDF_NAME, spark)
    before = rung.score(assigned).select(ID, F.col("probability").alias("before"))
    after = again.score(assigned).select(ID, F.col("probability").alias("after"))
    return before.join(after, ID).select(ID, (F.abs(F.col("before") - F.col("after")) < 1e-7).alias("same"))


def _numbered_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(place, embedding)``: one vector of each id, numbered from 0 in the order of the ids, whatever these are."""
    vectors = table(spark, folder, "embeddings").where("vec_id is not null and embedding is not null")
    one = materialise(vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "one-vector-each")
    places = one.select("vec_id").orderBy("vec_id").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    schema = T.StructType([one.schema["vec_id"], T.StructField("place", T.LongType())])
    return materialise(one.join(spark.createDataFrame(places, schema), "vec_id").select("place", "embedding"), "numbered")


def run_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """The whole experiment at its settings, with all three rungs; one row per model.

    The given vectors stand in for a pretrained model's: each sentence takes one of ``embeddings``. Of equal texts with
    several labels the first stands, as in the SQL; the evidence lists them.
    """
    labelled = views.labelled_documents(spark, folder)
    sentences = views.prepared_table(spark, folder).select(ID)
    vectors = _numbered_vectors(spark, folder)
    given = sentences.withColumn("place", F.pmod(F.xxhash64(ID), F.lit(vectors.count()))).join(vectors, "place")
    result = run(labelled, ["doc_id"], vectors=given.drop("place"), may_conflict=True)
    evidence = result.tables
    manifest = evidence["run_manifest"].first()
    rows = evidence["model_comparison"]
    best = rows.orderBy(F.desc("validation_macro_f1"), "model").first()["model"]
    ratios = evidence["cost_ratios"].select("model", "artifact_bytes_ratio", "inference_ms_per_sample_ratio")
    distinct = ratios.agg(F.count_distinct("artifact_bytes_ratio"), F.count_distinct("inference_ms_per_sample_ratio")).first()
    return rows.select(
        "model", "family",
        (F.lit(result.champion_model) == best).alias("champion_by_rule"),
        (F.col("artifact_bytes") > 0).alias("sized"),
        (F.col("inference_ms_per_sample") > 0).alias("timed"),
        F.lit(tuple(distinct) == (3, 3)).alias("own_costs"),
        *[F.lit(manifest[f"{name}_rows"]).cast("bigint").alias(f"{name}_rows") for name in SPLIT_NAMES],
        F.lit(manifest["raw_rows"]).cast("bigint").alias("raw_rows"),
    )


def run_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Stored archives to published evidence; one row per member read, with what the run published of it all.

    ``metrics_agree``: accuracies and positive rates counted again from the published test predictions.
    """
    path, target = stored_archives(spark, folder), fresh_path(spark, "evidence")
    found = run_stored(spark, path, ARCHIVE_SOURCES, target, pattern="*.zip").tables
    manifest = found["run_manifest"].first()
    comparison = {r["model"]: r["test_accuracy"] for r in found["model_comparison"].collect()}  # one row per model
    right = [F.avg(((F.col(f"{m}_probability") >= 0.5).cast("int") == F.col(LABEL)).cast("int")).alias(m) for m in comparison]
    again = found["test_predictions"].agg(*right).first()
    agree = all(abs(again[m] - value) < 1e-9 for m, value in comparison.items())
    counts = [
        F.lit(manifest[f"{name}_rows"]).cast("bigint").alias(f"{name}_rows")
        for name in ("raw", "prepared", *SPLIT_NAMES)
    ]
    members = found["input_checksums"].where(F.contains("path", F.lit("!/")))
    return members.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("member"),
        F.regexp_extract("path", "([0-9]+)[.]zip!/", 1).cast("bigint").alias("block"),
        "length", "actual_sha256", *counts, F.lit(agree).alias("metrics_agree"),
    )


QUERIES = {
    "logistic_fit": logistic_fit,
    "candidate_search": candidate_search,
    "embedding_rung": embedding_rung,
    "pretrained_rung": pretrained_rung,
    "score_batch": score_batch,
    "score_file": score_file,
    "model_roundtrip": model_roundtrip,
    "run_benchmark": run_benchmark,
    "run_archives": run_archives,
}


def _newton(steps: int = 12) -> list[str]:
    """The same fit as so many Newton steps: one CTE each, over all events."""
    ctes = ["rows as (select label, value / 100 as x from wide)",
            "w0 as (select cast(0 as double) as a, cast(0 as double) as b)"]
    for k in range(steps):
        ctes.append(f"""g{k} as (select any_value(a) as a, any_value(b) as b,
          any_value(a) + sum((p - label) * x) as ga, any_value(b) + sum(p - label) as gb,
          1 + sum(p * (1 - p) * x * x) as haa, sum(p * (1 - p) * x) as hab, 1 + sum(p * (1 - p)) as hbb
          from (select a, b, label, x, 1 / (1 + exp(-(a * x + b))) as p from rows, w{k}))""")
        ctes.append(f"""w{k + 1} as (select a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as a,
          b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b from g{k})""")
    return ctes


_CANDIDATES = ", ".join(
    f"({i}, '{name}', '{representation}', cast({c} as double))"
    for i, name, representation, c in learn.candidate_specs()
)
ORACLES: dict[str, str] = {
    "logistic_fit": views.sql(
        "wide", "select 0 as place, round(a, 6) as weight from w12 union all select 1, round(b, 6) from w12",
        *_newton(),
    ),
    "candidate_search": f"with counts as ({text_queries.ORACLES['feature_counts']}) "
    "select candidate_index, candidate, c.representation, c.C, feature_count, 'train_only' as trained_rows, "
    f"true as by_rule from (values {_CANDIDATES}) c(candidate_index, candidate, representation, C) "
    "join counts on counts.representation = c.representation",
    "embedding_rung": views.sql(
        "split",
        "select least(12000, 2 + (select count(distinct token) from (select unnest("
        f"{text_queries._TOKENS}) as token from assigned where split = 'train'))) as vocabulary, "
        "(select count(*) from assigned where split = 'train') as train_rows, "
        "true as best_by_rule, true as ended_by_rule",
    ),
    "run_benchmark": views.sql(
        "split",
        "select m.model, m.family, true as champion_by_rule, true as sized, true as timed, true as own_costs, "
        "count(*) filter (split = 'train') as train_rows, count(*) filter (split = 'validation') as validation_rows, "
        "count(*) filter (split = 'test') as test_rows, (select count(*) from labelled) as raw_rows "
        "from assigned, (values ('tfidf_logistic_regression', 'traditional'), "
        "('embedding_network', 'deep_learning_from_scratch'), ('pretrained_vectors', 'pretrained_vectors')) "
        "m(model, family) group by all",
    ),
    "pretrained_rung": "select candidate_index, candidate, C, cast((select max(len(embedding)) from embeddings) "
    "as bigint) as feature_count, 'train_only' as trained_rows, true as by_rule from (values "
    "(0, 'vectors_c0.5', cast(0.5 as double)), (1, 'vectors_c1', 1.0), (2, 'vectors_c2', 2.0)) "
    "c(candidate_index, candidate, C)",
    "score_batch": views.sql(
        "split",
        f"""select sentence_id, round(p, 6) as positive_probability, cast(p >= 0.5 as int) as predicted_label,
          case when p >= 0.5 then 'positive' else 'negative' end as predicted_sentiment,
          'tfidf_logistic_regression' as model
        from (select c.sentence_id, 1 / (1 + exp(-({_INTERCEPT} + coalesce(m.margin, 0)))) as p
          from chat c left join margins m on c.sentence_id = m.sentence_id)""",
        text_queries._TRAIN,
        "chat as (select conv_id || '-' || turn as sentence_id, text from conversations)",
        text_queries._word_terms("train", "train_w"),
        text_queries._word_terms("chat", "chat_w"),
        """idf as (select term, ln((1 + (select count(*) from train)) / cast(1 + count(distinct sentence_id) as double)) + 1
          as idf, (((length(term) * 5 + instr(term, 'e')) % 9) - 4) / 2.0 as weight from train_w group by term)""",
        """margins as (select sentence_id, sum(w * weight) / sqrt(sum(w * w)) as margin
          from (select sentence_id, (1 + ln(count(*))) * any_value(idf) as w, any_value(weight) as weight
            from chat_w join idf using (term) group by sentence_id, term) group by sentence_id)""",
    ),
    "model_roundtrip": views.sql("split", "select sentence_id, true as same from assigned"),
}
ORACLES["run_archives"] = views.sql(
    "split",
    f"""select m.*, (select count(*) from labelled) as raw_rows, n.* , true as metrics_agree from (
      select case doc_id % 2 when 0 then 'even.txt' else 'odd.txt' end as member, doc_id // {FILE_ROWS} as block,
        cast(sum(strlen(line)) as bigint) as length, sha256(string_agg(line, '' order by doc_id)) as actual_sha256
      from (select doc_id, regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g') || chr(9) || label || chr(10) as line
        from labelled) group by all) m,
      (select count(*) as prepared_rows, count(*) filter (split = 'train') as train_rows,
        count(*) filter (split = 'validation') as validation_rows, count(*) filter (split = 'test') as test_rows
      from assigned) n""",
)
# the same scores, by way of files
ORACLES["score_file"] = ORACLES["score_batch"]
