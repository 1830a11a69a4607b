"""The registered queries of the operators, at production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import (
    chat, decontaminate, hash_tree, kmeans_tree, lexical, line_dedup, packing, repair, resampling, simhash,
    substring_dedup, toxicity, url_filter,
)
from assayline.llm.columns import join_on
from assayline.session import materialise, table


def tokenizer_path() -> str:
    """Where the installed byte-level tokenizer's file is."""
    return public_tokenizers.path("byte_bpe_50k.json")


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    labels = table(spark, folder, "labels").where(~_held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).drop("text", "lang")
    return scored.select(
        "doc_id", _held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "flagged",
    )


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


NEIGHBOURS = 20


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, NEIGHBOURS)


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages).drop("url")


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    output = chat.format_conversations(given.unionByName(added))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss_text(F.col("segments"))
    read = output.select("conv_id", "valid", "formatted", turns.alias("turns"), loss.alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract: by the row's remainder it is dropped, emptied,
    robbed of its full stops, repeated, or given to the user."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *part).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    faulty = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return faulty.drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns, report = repair.repair(_damaged(given))
    found = join_on(given.select("conv_id").distinct(), report, ["conv_id"], "left")
    found = join_on(found, repair.digests(turns), ["conv_id"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


SHARDS = 8


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = hash_tree.assign(docs, hash_tree.uniform(SHARDS), ["doc_id"], "shard")
    grown = hash_tree.assign(placed, hash_tree.uniform(SHARDS + 1), ["doc_id"], "grown_shard")
    rows = materialise(grown, "sharded")
    slots = hash_tree.with_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


ANSWERS = 50


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ANSWERS)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op4_packing": op4_packing,
    "op3_line_dedup": op3_line_dedup,
    "op8_simhash": op8_simhash,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op3_line_dedup": """
with lines as (
  select doc_id, generate_subscripts(parts, 1) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), shared as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10
  group by key having count(distinct doc_id) > 1
), marked as (
  select k.*, s.key is not null and k.doc_id <> s.first_doc as gone
  from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op7_chat_format": r"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over w as place, lag(coalesce(role, ''), 1, '') over w as before,
    lead(1) over w is null as last
  from turns window w as (partition by conv_id order by turn, role, text)
), judged as (
  select *, case before when '' then role in ('system', 'user') when 'system' then role = 'user'
      when 'user' then role = 'assistant' when 'assistant' then role = 'user' else false end
      and (not last or role = 'assistant') as fits,
    case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7 else 17 + length(role) end
    + length(regexp_replace(text,
      '([\[<])(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|TURN\]|/TURN\]|AS\])', '\1\\\2\3', 'g')) as chars
  from placed
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, bool_and(fits) as valid
from judged group by conv_id
""",
    "op9_substring_dedup": r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), words as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from split
), windows as (
  select doc_id, generate_series as place, array_to_string(words[generate_series:generate_series + 19], ' ') as words
  from split, generate_series(1, cast(len(words) as bigint) - 19)
), judged as (
  select doc_id, place, row_number() over (partition by words order by doc_id, place) > 1 as gone from windows
), marked as (
  select w.doc_id, w.word, w.place, coalesce(max(cast(j.gone as int)) over (
    partition by w.doc_id order by w.place rows between 19 preceding and current row), 0) = 1 as gone
  from words w left join judged j on w.doc_id = j.doc_id and w.place = j.place
), counted as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
    string_agg(word, ' ' order by place) filter (where not gone) as kept
  from marked group by doc_id
)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join counted c on d.doc_id = c.doc_id
""",
    "op13_lexical_search": r"""
with texts as (
  select doc_id, row_number() over () as row, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), cut as (
  select doc_id, row, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from texts
), totals as (
  select count(*) filter (where len(terms) > 0) as docs, sum(len(terms)) as length from cut
), held as (
  select doc_id, row, n, term, count(*) as tf
  from (select doc_id, row, len(terms) as n, unnest(terms) as term from cut) group by all
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weights as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
  from held, totals group by term
), scored as (
  select item_id, row, any_value(doc_id) as doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) as bigint) as score
  from asked join held using (term) join weights using (term), totals group by item_id, row
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scored where score > 0
)
select * from ranked where rank <= 50
""",
}
