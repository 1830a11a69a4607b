"""Queries over ingest, contracts, duplicates, splits, profiles and sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.text import stable_id, text_key
from assayline.operators import dedup, profile, quality, score, split
from assayline.plans import views
from assayline.plans.views import rounded, sql
from assayline.session import fresh_path, materialise, spread_table, table
from assayline.sources import archives, files, lines, tables
from assayline.sources.files import open_place

_ONE_LINE = r"[\t\n\r]+"


def _as_lines(rows: DataFrame) -> DataFrame:
    value = F.concat_ws("\t", F.regexp_replace("text", _ONE_LINE, " "), F.col("label"))
    return rows.select("source", (F.col("doc_id") + 1).alias("line_number"), value.alias("value"))


def parse_labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    parsed = lines.parse_lines(_as_lines(views.labelled_documents(spark, folder)))
    return lines.labelled_rows(parsed)


def scan_labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Write the lines of every source as text files, scan them back with line numbers."""
    path = fresh_path(spark, "lines")
    built = _as_lines(views.labelled_documents(spark, folder))
    built.select("source", "value").write.partitionBy("source").option("lineSep", "\n").text(path)
    scan = lines.scan_lines(spark, f"{path}/*")
    found = scan.withColumn("source", F.regexp_extract("path", "source=([^/]+)", 1))
    parsed = lines.require_parsed(lines.parse_lines(found))
    per_file = parsed.groupBy("source", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("line_number").alias("last"),
        F.sum("line_number").alias("total"),
        F.sum("label").alias("positives"),
    )
    # Line numbers of a file are exactly 1..n, each once.
    exact = (F.col("last") == F.col("n")) & (F.col("total") * 2 == F.col("n") * (F.col("n") + 1))
    return per_file.groupBy("source").agg(
        F.sum("n").alias("lines"),
        F.sum("positives").alias("positives"),
        F.bool_and(exact).alias("numbered_exactly"),
    )


_DAMAGED = """
select lang as source, d.doc_id + 1 as line_number,
  case when l.doc_id is null then {one_line}
       when l.toxic = 1 then ' \t1'
       when n_chars % 7 = 0 then {one_line} || '\t2'
       when n_chars % 11 = 0 then ''
       else {one_line} || '\t1' end as value
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""


def malformed_lines(spark: SparkSession, folder: str) -> DataFrame:
    query = _DAMAGED.format(
        one_line="translate(text, '\t\n\r', '   ')", documents="{documents}", labels="{labels}"
    )
    damaged = spark.sql(
        query, documents=spread_table(spark, folder, "documents", ["doc_id", "lang", "text", "n_chars"]),
        labels=table(spark, folder, "labels"),
    )
    bad = lines.malformed_rows(lines.parse_lines(damaged))
    return bad.select("source", "line_number", "reason")


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, chat turns and benchmark items stacked as three ranked sources."""
    key = lambda c: F.col(c).cast("string").alias("item")
    return lines.union_sources(
        {
            "documents": table(spark, folder, "documents").select(key("doc_id"), "text"),
            "conversations": table(spark, folder, "conversations").select(
                F.concat_ws("-", "conv_id", "turn").alias("item"), "text"
            ),
            "benchmark": table(spark, folder, "benchmark").select(key("item_id"), "text"),
        }
    ).select("source", "source_order", "item", F.char_length("text").alias("characters"))


def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, against a manifest in upper case with wrong, malformed and missing entries."""
    rows = table(spark, folder, "documents")
    content = F.col("text").cast("binary")
    named = F.col("doc_id").cast("string")
    found = files.file_checksums(
        rows.select(named.alias("path"), F.octet_length("text").alias("length"), content.alias("content"))
    )
    kind = F.col("doc_id") % 10
    manifest = rows.select(
        F.when(kind == 2, F.concat(F.lit("absent/"), named)).otherwise(named).alias("path"),
        F.when(kind == 0, F.repeat(F.lit("0"), F.lit(64)))
        .when(kind == 1, F.lit("no digest"))
        .otherwise(F.upper(F.sha2(content, 256))).alias("expected_sha256"),
    )
    return files.verify_checksums(found, manifest)


FILE_ROWS = 500


def stored_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Write the documents as files of some hundred lines each, then hash the files where they lie.

    Files beyond a megabyte are hashed chunk by chunk, the others as one value.
    """
    path = fresh_path(spark, "files")
    rows = table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / FILE_ROWS).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value")
    )
    cores = spark.sparkContext.defaultParallelism
    dealt = rows.repartition(4 * cores, "file").sortWithinPartitions("file", "doc_id")
    dealt.select("file", "value").write.partitionBy("file").option("lineSep", "\n").text(path)
    found = files.stored_checksums(spark, path, "*.txt", whole_bytes=1 << 20)
    number = F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint")
    return found.select(number.alias("file"), "length", "actual_sha256")


def _zip_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for number, batch in enumerate(batches):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for label in (0, 1):
                body = "".join(f"{v}\n" for v in batch.loc[batch["label"] == label, "value"])
                archive.writestr(f"nested/folder/label_{label}.txt", body)
            archive.writestr("readme.txt", "not a member")
        name = f"{batch['line_number'].iloc[0]}-{number}.zip"
        yield pd.DataFrame({"path": [name], "content": [buffer.getvalue()]})


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """Zip the labelled lines batch by batch, then resolve, read and parse the members."""
    rows = views.labelled_documents(spark, folder)
    built = _as_lines(rows).withColumn("label", F.substring_index("value", "\t", -1).cast("int"))
    archives = built.mapInPandas(_zip_batches, "path string, content binary")
    names = ["label_0.txt", "label_1.txt"]
    members = files.require_members(files.archive_members(archives), names)
    parsed = lines.labelled_rows(lines.parse_lines(files.member_lines(members)))
    return parsed.groupBy("basename", "label").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("characters")
    )


def _zip_file(folder: str):
    def write(block: pd.DataFrame) -> pd.DataFrame:
        store, place = open_place(folder)
        name = f"{place}/{block['block'].iloc[0]:09d}.zip"
        ordered = block.sort_values("line_number")
        with store.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for odd, member in enumerate(("even.txt", "odd.txt")):
                values = ordered.loc[ordered["odd"] == odd, "value"]
                archive.writestr(f"nested/{member}", "".join(f"{v}\n" for v in values))
            archive.writestr("readme.txt", "not a member")
        return pd.DataFrame({"name": [name], "lines": [len(block)]})

    return write


def stored_archives(spark: SparkSession, folder: str) -> str:
    """The labelled documents as zip files of some hundred lines each, in the shared folder."""
    path = fresh_path(spark, "archives")
    # a table written there makes the folder; Spark's readers pass over names that begin with _
    spark.range(1).write.parquet(f"{path}/_made")
    place = path if ":" in path else f"file://{path}"
    rows = _as_lines(views.labelled_documents(spark, folder)).withColumns({
        "block": F.floor((F.col("line_number") - 1) / FILE_ROWS), "odd": ((F.col("line_number") - 1) % 2).cast("int"),
    })
    written = rows.drop("source").groupBy("block").applyInPandas(_zip_file(place), "name string, lines bigint")
    materialise(written, "archives-written")
    return path


#: Members of those archives and their sources, in the order that decides which of equal texts is first.
ARCHIVE_SOURCES = {"even.txt": "even", "odd.txt": "odd"}


def prepare_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Stored archives, checked against a manifest of their checksums, to the published table.

    Odd lines may all repeat even ones, as in a table of copies with keys shifted by an odd number. Of equal texts with
    several labels the first stands, as in the SQL.
    """
    path = stored_archives(spark, folder)
    sums = files.stored_checksums(spark, path, "*.zip")
    manifest = materialise(sums.select("path", F.col("actual_sha256").alias("expected_sha256")), "manifest")
    target = fresh_path(spark, "prepared-archives")
    found = archives.prepare_archives(
        spark, path, ARCHIVE_SOURCES, target, manifest, pattern="*.zip", may_repeat=True, may_conflict=True
    )
    return found.rows


def text_keys(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "documents", ["doc_id", "text"]).select("doc_id", text_key(F.col("text")).alias("key"))


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    keys = text_keys(spark, folder)
    return keys.select("doc_id", stable_id(F.col("key")).alias("sentence_id"))


def validate_contract(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validate_contract(views.sentences(spark, folder), ["de", "en", "fr"])


def validate_assignments(spark: SparkSession, folder: str) -> DataFrame:
    assignments = views.assignments(spark, folder)
    return quality.validate_assignments(assignments, stable_ids(spark, folder))


def validate_splits(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validate_splits(views.assigned(spark, folder))


def scoring_input(spark: SparkSession, folder: str) -> DataFrame:
    return score.with_default_ids(table(spark, folder, "conversations").select("text"))


def scoring_checks(spark: SparkSession, folder: str) -> DataFrame:
    by_conversation = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("sentence_id"), "text"
    )
    return score.scoring_violations(by_conversation)


def apply_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.prepared_table(spark, folder)
    applied = split.apply_split(rows, split.stratified_split(rows))
    return applied.select("sentence_id", "source", "label", "split")


def id_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return quality.id_reconcile(
        table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id"
    )


def leakage_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows split before deduplication, so copies do land in different splits."""
    rows = materialise(views.sentences(spark, folder), "sentences")
    return split.leakage_audit(split.apply_split(rows, split.stratified_split(rows), check=False))


def _props(spark: SparkSession, folder: str) -> DataFrame:
    return views.scored_wide(spark, folder).select(F.col("props").alias("text"), "label")


def assignments_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "assignments")
    tables.write_assignments(views.assignments(spark, folder), path)
    return tables.read_assignments(spark, path)


def _write_and_read(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    path = fresh_path(spark, f"prepared-{fmt}")
    tables.write_prepared(views.prepared_table(spark, folder), path, fmt)
    return tables.read_prepared(spark, path, fmt)


def strict_json_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.scored(spark, folder)
    in_thousandths = F.array(F.round(F.col("probability") * 1000).cast("bigint"))  # one spelling everywhere
    return tables.strict_json_rows(
        rows.select("sentence_id", "source", "label", "model", "split", in_thousandths.alias("probability"))
    )


def artifact_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Size of a text table of the documents, one line each."""
    path = fresh_path(spark, "lines")
    flat = F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    table(spark, folder, "documents").select(flat).write.text(path)
    return files.artifact_bytes(spark, path).select("artifact_bytes")


def run_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.labelled_documents(spark, folder)
    ready = views.prepared_table(spark, folder)
    settings = vars(split.SplitConfig())
    manifest = tables.run_manifest(ready, split.stratified_split(ready), rows.count(), settings)
    return manifest.drop("created_at_utc", "config", "champion_model")


def small_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by (source, quality): many sources with few labelled rows."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return split.small_strata(rows.withColumn("label", F.col("quality").cast("bigint")), 8)


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    raw = views.labelled_documents(spark, folder).count()
    return rounded(profile.dataset_summary(raw, views.assigned(spark, folder)))


def table_digest(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["sentence_id", "source", "text", "label"]
    return tables.table_digest(views.prepared(spark, folder), columns)


QUERIES = {
    "parse_labelled_lines": parse_labelled_lines,
    "scan_labelled_lines": scan_labelled_lines,
    "malformed_lines": malformed_lines,
    "union_sources": union_sources,
    "file_checksums": file_checksums,
    "archive_members": archive_members,
    "prepare_archives": prepare_archives,
    "text_key": text_keys,
    "stable_id": stable_ids,
    "prepare": views.prepared,
    "dedup_keep_first": lambda s, f: dedup.dedup_keep_first(
        views.labelled_documents(s, f), ["doc_id"]
    ).select("doc_id", "source", "text", "label"),
    "dedup_counts": lambda s, f: dedup.dedup_counts(views.labelled_documents(s, f)),
    "duplicate_groups": lambda s, f: dedup.duplicate_groups(views.labelled_documents(s, f)),
    "label_conflicts": lambda s, f: dedup.label_conflicts(_props(s, f)),
    "validate_contract": validate_contract,
    "validate_assignments": validate_assignments,
    "validate_splits": validate_splits,
    "scoring_input": scoring_input,
    "scoring_checks": scoring_checks,
    "stratified_split": views.assignments,
    "small_strata": small_strata,
    "apply_split": apply_split,
    "id_reconcile": id_reconcile,
    "leakage_audit": leakage_audit,
    "class_coverage": lambda s, f: quality.class_coverage(views.sentences(s, f)),
    "class_balance": lambda s, f: profile.class_balance(views.sentences(s, f)),
    "dataset_summary": dataset_summary,
    "source_profile": lambda s, f: rounded(profile.source_profile(views.prepared(s, f))),
    "split_distribution": lambda s, f: rounded(profile.split_distribution(views.assigned(s, f))),
    "length_histogram": lambda s, f: profile.length_histogram(views.prepared(s, f)),
    "text_lengths": lambda s, f: profile.with_lengths(
        spread_table(s, f, "documents", ["doc_id", "text"])
    ).select(
        "doc_id", "characters", "words"
    ),
    "assignments_roundtrip": assignments_roundtrip,
    "write_prepared": lambda s, f: _write_and_read(s, f, "parquet"),
    "read_prepared": lambda s, f: _write_and_read(s, f, "csv"),
    "strict_json_rows": strict_json_rows,
    "table_digest": table_digest,
    "stored_checksums": stored_checksums,
    "artifact_bytes": artifact_bytes,
    "run_manifest": run_manifest,
}

_LINE = "trim(regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g'), ' ')"
_PREPARED = sql("prepared", "select sentence_id, source, text, label from prepared")
_ASSIGNMENTS = sql("split", "select sentence_id, split from assigned")
_DIGEST_ROWS = """hashed as (
  select sha256(concat(length(sentence_id), ':', sentence_id, length(source), ':', source,
    length(text), ':', text, length(cast(label as varchar)), ':', label)) as h
  from prepared)"""
_DIGEST = "sha256(concat_ws(',', cast(count(*) as varchar), {}))".format(
    ", ".join(
        f"cast(coalesce(sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as ubigint)), 0) as varchar)"
        for i in range(8)
    )
)
_SPLIT_DIGEST = """split_hashed as (
  select sha256(concat(length(sentence_id), ':', sentence_id, length(split), ':', split)) as h
  from assigned)"""
_DOC_KEY = (
    r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))"
)


def _rules(*counts: tuple[str, str]) -> str:
    return " union all ".join(
        f"select {i} as rule_order, '{rule}' as rule, cast({count} as bigint) as violations"
        for i, (rule, count) in enumerate(counts, start=1)
    )


def _pairs(view: str) -> str:
    out = []
    for kind, column in (("id", "sentence_id"), ("text", "k")):
        for left, right in (("train", "validation"), ("train", "test"), ("validation", "test")):
            out.append(
                f"select '{kind}' as kind, '{left}' as left_split, '{right}' as right_split, "
                f"count(*) as shared from (select {column} from {view} where split = '{left}' "
                f"intersect select {column} from {view} where split = '{right}')"
            )
    return " union all ".join(out)


# The split of un-deduplicated rows: the same rules over another table.
_RAW_SPLIT = sql(
    "split",
    _pairs("keyed_split"),
    f"keyed_split as (select sentence_id, split, {_DOC_KEY} as k from assigned)",
).replace(
    "select 'sentence_' || sha256(k) as sentence_id, source, text, label from (\n"
    "    select *, row_number() over (partition by k order by doc_id) as rn from keyed)\n"
    "  where rn = 1",
    "select sentence_id, source, text, label from labelled",
)

ORACLES = {
    "parse_labelled_lines": sql(
        "labelled",
        f"select source, doc_id + 1 as line_number, {_LINE} as text, label from labelled",
    ),
    "scan_labelled_lines": sql(
        "labelled",
        "select source, count(*) as lines, sum(label) as positives, true as numbered_exactly "
        "from labelled group by source",
    ),
    "malformed_lines": f"""
select source, line_number,
  case when value = '' then 'empty line' when position(chr(9) in value) = 0 then 'no tab'
       when trim(regexp_extract(value, '(?s)^(.*)\\t[^\\t]*$', 1)) = '' then 'empty text'
       else 'invalid label' end as reason
from ({_DAMAGED.format(one_line="translate(text, chr(9) || chr(10) || chr(13), '   ')",
                       documents="documents", labels="labels")})
where value = '' or position(chr(9) in value) = 0
   or trim(regexp_extract(value, '(?s)^(.*)\\t[^\\t]*$', 1)) = ''
   or regexp_extract(value, '\\t([^\\t]*)$', 1) not in ('0', '1')""",
    "union_sources": """
select 'documents' as source, 0 as source_order, cast(doc_id as varchar) as item,
       length(text) as characters from documents
union all select 'conversations', 1, conv_id || '-' || turn, length(text) from conversations
union all select 'benchmark', 2, cast(item_id as varchar), length(text) from benchmark""",
    "archive_members": sql(
        "labelled",
        f"select 'label_' || label || '.txt' as basename, label, count(*) as lines, "
        f"sum(length({_LINE})) as characters from labelled group by all",
    ),
    "prepare_archives": sql(
        "keyed",
        f"select 'sentence_' || sha256(k) as sentence_id, case doc_id % 2 when 0 then 'even' else 'odd' end as source, "
        f"{_LINE} as text, label from (select *, row_number() over (partition by k order by doc_id % 2, doc_id) as rn "
        "from keyed) where rn = 1",
    ),
    "text_key": f"select doc_id, {_DOC_KEY} as key from documents",
    "stable_id": f"select doc_id, 'sentence_' || sha256({_DOC_KEY}) as sentence_id from documents",
    "prepare": _PREPARED,
    "dedup_keep_first": sql(
        "keyed",
        "select doc_id, source, text, label from (select *, row_number() over "
        "(partition by k order by doc_id) as rn from keyed) where rn = 1",
    ),
    "dedup_counts": sql(
        "keyed",
        "select count(*) as raw_rows, count(distinct k) as prepared_rows, "
        "count(*) - count(distinct k) as removed from keyed",
    ),
    "duplicate_groups": sql(
        "keyed",
        "select 'sentence_' || sha256(k) as sentence_id, count(*) as rows, "
        "min(label) <> max(label) as conflict from keyed group by k having count(*) > 1",
    ),
    "label_conflicts": sql(
        "wide",
        "select 'sentence_' || sha256(lower(props)) as sentence_id, count(*) as rows, "
        "min(label) as min_label, max(label) as max_label from wide group by lower(props) "
        "having count(distinct label) > 1",
    ),
    "validate_contract": sql(
        "keyed",
        _rules(
            ("columns", "0"),
            ("non_empty", "(select (count(*) = 0)::int from keyed)"),
            (
                "no_nulls",
                "(select count(*) from keyed where sentence_id is null or source is null "
                "or text is null or label is null)",
            ),
            ("id_not_blank", "(select count(*) from keyed where trim(sentence_id) = '')"),
            (
                "id_unique",
                "(select count(*) from (select 1 from keyed group by sentence_id "
                "having count(*) > 1))",
            ),
            ("text_not_blank", "(select count(*) from keyed where k = '')"),
            ("label_integer", "0"),
            ("label_binary", "(select count(*) from keyed where label not in (0, 1))"),
            (
                "source_set",
                "(select count(distinct source) from keyed where source not in "
                "('de', 'en', 'fr')) + 3 - (select count(distinct source) from keyed "
                "where source in ('de', 'en', 'fr'))",
            ),
            (
                "source_has_both_labels",
                "(select count(*) from (select 1 from keyed group by source "
                "having count(distinct label) < 2))",
            ),
            (
                "key_unique",
                "(select count(*) from (select 1 from keyed group by k having count(*) > 1))",
            ),
        ),
    ),
    "validate_assignments": sql(
        "split",
        _rules(
            ("columns", "0"),
            ("non_empty", "0"),
            ("no_nulls", "(select count(*) from assigned where split is null)"),
            ("id_not_blank", "0"),
            (
                "id_unique",
                "(select count(*) - count(distinct sentence_id) from assigned)",
            ),
            ("split_set", "(select 3 - count(distinct split) from assigned)"),
            (
                "ids_missing",
                "(select count(*) from (select id from expected except "
                "select sentence_id from assigned))",
            ),
            (
                "ids_extra",
                "(select count(*) from (select sentence_id from assigned except "
                "select id from expected))",
            ),
        ),
        f"expected as (select 'sentence_' || sha256({_DOC_KEY}) as id from documents)",
    ),
    "validate_splits": sql(
        "split",
        "select split, count(*) as rows, count(*) filter (trim(text) = '') as bad_text, "
        "count(*) filter (split <> 'test' and label not in (0, 1)) as bad_label, "
        "case when split = 'train' then 2 - count(distinct label) else 0 end as missing_class "
        "from assigned group by split",
    ),
    "scoring_input": "select printf('input_%06d', row_number() over (order by conv_id, turn) - 1) "
    "as sentence_id, text from conversations",
    "scoring_checks": _rules(
        ("non_empty", "(select (count(*) = 0)::int from conversations)"),
        ("text_present", "(select count(*) from conversations where trim(text) = '')"),
        ("id_present", "(select count(*) from conversations where conv_id is null)"),
        (
            "id_unique",
            "(select count(*) from (select 1 from conversations group by conv_id "
            "having count(*) > 1))",
        ),
    ),
    "stratified_split": _ASSIGNMENTS,
    "small_strata": "select source, cast(quality as bigint) as label, count(*) as rows "
    "from documents join labels using (doc_id) group by all having count(*) < 8",
    "apply_split": sql("split", "select sentence_id, source, label, split from assigned"),
    "id_reconcile": """
select (select count(*) from (select doc_id from documents except select doc_id from labels))
         as missing,
       (select count(*) from (select doc_id from labels except select doc_id from documents))
         as extra,
       (select count(*) from (select doc_id from labels intersect select doc_id from documents))
         as shared""",
    "leakage_audit": _RAW_SPLIT,
    "class_coverage": sql(
        "labelled",
        "select source, count(*) filter (label = 0) as negatives, count(*) filter (label = 1) "
        "as positives, count(distinct label) = 2 as has_both from labelled group by source",
    ),
    "class_balance": sql(
        "labelled",
        "select source, count(*) filter (label = 0) as negative, count(*) filter (label = 1) "
        "as positive from labelled group by source",
    ),
    "dataset_summary": sql(
        "split",
        "select (select count(*) from labelled) as raw_rows, count(*) as prepared_rows, "
        "(select count(*) from labelled) - count(*) as duplicates_removed, "
        "round(avg(label), 9) as positive_rate, "
        "string_agg(distinct source, ',' order by source) as sources, "
        "count(distinct source) as source_count, 0 as missing_cells, "
        "count(*) filter (split = 'train') as train_rows, "
        "count(*) filter (split = 'validation') as validation_rows, "
        "count(*) filter (split = 'test') as test_rows from assigned",
    ),
    "source_profile": sql(
        "prepared",
        "select source, count(*) as rows, round(avg(label), 9) as positive_rate, "
        "round(quantile_cont(length(text), 0.5), 9) as median_characters, "
        "round(quantile_cont(length(text), 0.95), 9) as p95_characters, "
        r"round(quantile_cont(len(regexp_extract_all(text, '\S+')), 0.5), 9) as median_words "
        "from prepared group by source",
    ),
    "split_distribution": sql(
        "split",
        "select split, source, count(*) as rows, round(avg(label), 9) as positive_rate "
        "from assigned group by split, source",
    ),
    "length_histogram": sql(
        "prepared",
        "select source, cast(least(floor(w / 5), last / 5 - 1) * 5 as bigint) as bin_start, "
        "count(*) as rows from counted, edge where w <= last group by all",
        r"counted as (select source, len(regexp_extract_all(text, '\S+')) as w from prepared)",
        "edge as (select floor((max(w) + 5 - 1) / 5) * 5 as last from counted)",
    ),
    "text_lengths": r"select doc_id, length(text) as characters, "
    r"len(regexp_extract_all(text, '\S+')) as words from documents",
    "assignments_roundtrip": _ASSIGNMENTS,
    "write_prepared": _PREPARED,
    "read_prepared": _PREPARED,
    "file_checksums": """
select case when doc_id % 10 = 2 then 'absent/' || doc_id else cast(doc_id as varchar) end as path,
  case doc_id % 10 when 0 then repeat('0', 64) when 1 then 'no digest' else sha256(text) end as expected_sha256,
  case when doc_id % 10 <> 2 then sha256(text) end as actual_sha256,
  case doc_id % 10 when 0 then 'mismatch' when 1 then 'malformed' when 2 then 'missing' else 'ok' end as status
from documents""",
    "stored_checksums": f"""
select cast(doc_id // {FILE_ROWS} as bigint) as file, cast(sum(strlen(coalesce(text, '')) + 1) as bigint) as length,
  sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as actual_sha256
from documents group by all""",
    "artifact_bytes": "select cast(sum(strlen(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) + 1) as bigint) "
    "as artifact_bytes from documents",
    "strict_json_rows": sql(
        "scored",
        "select cast(to_json(struct_pack(label := label, model := model, "
        "probability := [cast(round(probability * 1000) as bigint)], sentence_id := sentence_id, source := source, split := split)) as varchar) as value "
        "from scored",
    ),
    "table_digest": sql(
        "prepared", f"select count(*) as rows, {_DIGEST} as digest from hashed", _DIGEST_ROWS
    ),
    "run_manifest": sql(
        "split",
        f"select (select count(*) from labelled) as raw_rows, "
        f"(select count(*) from prepared) as prepared_rows, "
        f"(select {_DIGEST} from hashed) as prepared_digest, "
        f"(select {_DIGEST} from split_hashed) as assignment_digest, "
        "count(*) filter (split = 'train') as train_rows, "
        "count(*) filter (split = 'validation') as validation_rows, "
        "count(*) filter (split = 'test') as test_rows, "
        "'validation macro-F1' as selection_metric, true as test_excluded_from_selection, "
        "cast(0.5 as double) as decision_threshold from assigned",
        _DIGEST_ROWS,
        _SPLIT_DIGEST,
    ),
}
