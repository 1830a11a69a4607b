"""The labelled-text views the queries read, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.operators.dedup import prepare
from assayline.operators.split import SplitConfig, apply_split, stratified_split
from assayline.session import materialise, spread_table, table


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(sentence_id, source, text, label, doc_id)`` of every labelled document."""
    documents = spread_table(spark, folder, "documents", ["doc_id", "lang", "text"])
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("sentence_id"),
        F.col("lang").alias("source"),
        "text",
        F.col("quality").cast("bigint").alias("label"),
        "doc_id",
    )


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_documents(spark, folder).drop("doc_id")


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(labelled_documents(spark, folder), ["doc_id"])


def prepared_table(spark: SparkSession, folder: str) -> DataFrame:
    """The prepared rows written once: deduplication is not repeated by each later read."""
    return materialise(prepared(spark, folder), "prepared")


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(prepared_table(spark, folder))


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared_table(spark, folder)
    return apply_split(rows, stratified_split(rows), check=False)


_SCORED = """
select event_id as id, event_type as source,
  cast(((event_id*104729+7)%997)/cast(997 as double)
       < ((event_id*7919+13)%1000)/cast(1000 as double) as int) as label,
  ((event_id*7919+13)%1000)/cast(1000 as double) as p_a,
  (6*((event_id*7919+13)%1000) + 4*((event_id*3571+29)%1000))/cast(10000 as double) as p_b,
  case when event_id % 2 = 0 then 'validation' else 'test' end as split,
  ts, value, user_id, props
from {events}
"""


def scored_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a label and two models' probabilities, half validation and half test."""
    return spark.sql(_SCORED.format(events="{events}"), events=table(spark, folder, "events"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Long form ``(sentence_id, source, label, split, model, probability)``."""
    return long_form(scored_wide(spark, folder))


def long_form(wide: DataFrame) -> DataFrame:
    models = F.array(
        F.struct(F.lit("a").alias("model"), F.col("p_a").alias("probability")),
        F.struct(F.lit("b").alias("model"), F.col("p_b").alias("probability")),
    )
    return wide.select(
        F.col("id").cast("string").alias("sentence_id"),
        "source",
        "label",
        "split",
        F.inline(models),
    )


def long_form_with(wide: DataFrame, column: Column, name: str) -> DataFrame:
    """Long form with one extra column taken from the event."""
    kept = wide.withColumn(name, column)
    pairs = F.array(
        F.struct(F.lit("a").alias("model"), F.col("p_a").alias("probability")),
        F.struct(F.lit("b").alias("model"), F.col("p_b").alias("probability")),
    )
    return kept.select(name, "label", F.inline(pairs))


def embedding_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("sentence_id"),
        F.lit("vectors").alias("source"),
        "embedding",
        (F.col("label") >= 5).cast("bigint").alias("label"),
    )


def chat_input(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("sentence_id"), "text"
    )


def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Cost figures per event type, standing in for measured model runs."""
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.sum("value").alias("train_seconds"),
        (F.sum("value") / 1000).alias("inference_seconds"),
        F.count_if(F.col("value") > 10).alias("inference_samples"),
        F.count(F.lit(1)).alias("parameter_count"),
        F.sum(F.octet_length("props")).cast("bigint").alias("artifact_bytes"),
    )


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column; sums in another order differ in the last bits."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema
        ]
    )


# --- the same views as SQL -------------------------------------------------------------

_TEST = SplitConfig().test_size
_RELATIVE = SplitConfig().validation_size / (1 - _TEST)

CTES = {
    "labelled": """labelled as (
  select cast(d.doc_id as varchar) as sentence_id, d.lang as source, d.text,
         cast(l.quality as bigint) as label, d.doc_id
  from documents d join labels l on d.doc_id = l.doc_id)""",
    # Test texts hold only Latin-1 letters: NFC equals NFKC there, and full case folding is
    # lower case plus sharp s.
    "keyed": r"""keyed as (
  select *, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'),
                                '\s+', ' ', 'g')) as k
  from labelled)""",
    "prepared": """prepared as (
  select 'sentence_' || sha256(k) as sentence_id, source, text, label from (
    select *, row_number() over (partition by k order by doc_id) as rn from keyed)
  where rn = 1)""",
    "split": f"""sizes as (
  select source, label, count(*) as n from prepared group by all),
quota0 as (
  select *, ceil(cast({_TEST!r} as double) * sum(n) over ()) as target,
         n * ceil(cast({_TEST!r} as double) * sum(n) over ()) / sum(n) over () as exact
  from sizes),
quota1 as (
  select source, label, n, floor(exact) + cast(row_number() over (
           order by exact - floor(exact) desc, source, label)
           <= target - sum(floor(exact)) over () as int) as tq
  from quota0),
quota2 as (
  select *, n - tq as rest,
         ceil(cast({_RELATIVE!r} as double) * sum(n - tq) over ()) as target,
         (n - tq) * ceil(cast({_RELATIVE!r} as double) * sum(n - tq) over ())
           / sum(n - tq) over () as exact
  from quota1),
quota as (
  select source, label, tq, floor(exact) + cast(row_number() over (
           order by exact - floor(exact) desc, source, label)
           <= target - sum(floor(exact)) over () as int) as vq
  from quota2),
assigned as (
  select p.sentence_id, p.source, p.text, p.label,
         case when r <= tq then 'test' when r <= tq + vq then 'validation'
              else 'train' end as split
  from (select *, row_number() over (partition by source, label
                 order by sha256('42|' || sentence_id), sentence_id) as r from prepared) p
  join quota q on p.source = q.source and p.label = q.label)""",
    "wide": f"wide as ({_SCORED.format(events='events')})",
    "scored": """scored as (
  select cast(id as varchar) as sentence_id, source, label, split, 'a' as model,
         p_a as probability from wide
  union all
  select cast(id as varchar), source, label, split, 'b', p_b from wide)""",
}
_NEEDS = {
    "labelled": [],
    "keyed": ["labelled"],
    "prepared": ["labelled", "keyed"],
    "split": ["labelled", "keyed", "prepared"],
    "wide": [],
    "scored": ["wide"],
}


def sql(view: str, body: str, *more: str) -> str:
    """``with <views> <body>``; ``more`` are further CTEs put before the body."""
    names = [*_NEEDS[view], view]
    return "with " + ",\n".join([*[CTES[n] for n in names], *more]) + "\n" + body
