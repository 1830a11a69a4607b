"""Vocabulary, encoding, n-gram counts and TF-IDF weights; fitted on train rows only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from assayline.functions.tokens import (
    RESERVED_IDS,
    UNKNOWN_ID,
    pad_tokens,
    regex_tokens,
    with_char_ngrams,
    with_term_counts,
    with_word_ngrams,
)
from assayline.operators import terms
from assayline.operators.terms import weights, with_idf
from assayline.schema import ID, TEXT
from assayline.session import materialise

# Entries of a vocabulary that travel to the tasks at once.
SHIPPED_VOCABULARY = 500_000

# The term blocks of each representation, each adding an array of terms.
BLOCKS: dict[str, dict[str, Callable[[DataFrame, str, str], DataFrame]]] = {
    "word_unigram": {"w": partial(with_word_ngrams, low=1, high=1)},
    "word_bigram": {"w": partial(with_word_ngrams, low=1, high=2)},
    "word_char": {
        "w": partial(with_word_ngrams, low=1, high=2),
        "c": partial(with_char_ngrams, low=3, high=5),
    },
}
REGULARISATION = (0.5, 1.0, 2.0)


def with_tokens(df: DataFrame, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, regex_tokens(F.coalesce(F.col(TEXT), F.lit(""))))


def vocabulary(train: DataFrame, max_size: int) -> DataFrame:
    """``(token, token_id, n)``: the most frequent train tokens, ids from 2.

    Ids 0 and 1 stand for padding and unknown. Only the kept head is ordered globally; its
    size is the parameter.
    """
    if max_size < RESERVED_IDS:
        raise ValueError("the vocabulary must leave room for padding and unknown")
    tokens = _flat(with_tokens(train).select(F.explode_outer("tokens").alias("token")), "token")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.orderBy(F.col("n").desc(), "token").limit(max_size - RESERVED_IDS)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "token"))
    return kept.select("token", (rank + F.lit(RESERVED_IDS - 1)).alias("token_id"), "n")


def _bounded(df: DataFrame, max_tokens: int | None) -> DataFrame:
    if max_tokens is not None and max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    tokens = with_tokens(df)
    if max_tokens is None:
        return tokens
    return tokens.withColumn("tokens", F.slice("tokens", 1, max_tokens))


def encode_text(
    df: DataFrame,
    vocab: DataFrame,
    max_tokens: int | None = None,
    shipped: int = SHIPPED_VOCABULARY,
) -> DataFrame:
    """Add ``token_ids``; unknown tokens become 1 and a text without tokens ``[1]``.

    ``max_tokens`` bounds the sequence as a model asks for it; by default every token of
    the text is encoded. Rows stay where they are: the vocabulary travels to the tasks, sorted by a hash of the token, in
    shards of about ``shipped`` entries, each of which fills in the ids it knows.
    """
    tokens = _bounded(df, max_tokens)
    hashed = tokens.withColumn("_hashes", F.transform("tokens", lambda t: F.xxhash64(t)))
    encoded = hashed.withColumn("token_ids", F.array().cast("array<int>"))
    words = vocab.select("token", "token_id", F.xxhash64("token").alias("hash"))
    count = -(-words.count() // shipped) or 1
    for number in range(count):
        shard = words.where(F.pmod(F.xxhash64("hash"), F.lit(count)) == number).toArrow()
        encoded = encoded.withColumn("token_ids", _lookup(shard, df.sparkSession)("tokens", "_hashes", "token_ids"))
    known = F.when(F.size("token_ids") == 0, F.array(F.lit(UNKNOWN_ID))).otherwise(F.col("token_ids"))
    return encoded.drop("tokens", "_hashes").withColumn("token_ids", known)


def _lookup(shard: pa.Table, spark: SparkSession) -> Callable[..., Column]:
    """Ids of tokens by their hashes, the strings compared as well; others keep their id."""
    hashes = shard.column("hash").to_numpy()
    order = np.argsort(hashes)
    words = shard.column("token").combine_chunks().take(pa.array(order))
    sent = spark.sparkContext.broadcast((hashes[order], words, shard.column("token_id").to_numpy()[order]))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(tokens: pa.Array, keys: pa.Array, before: pa.Array) -> pa.Array:
        known, words, ids = sent.value
        asked = keys.flatten().to_numpy(zero_copy_only=False)
        found = before.flatten().to_numpy(zero_copy_only=False)
        found = found.copy() if len(found) == len(asked) else np.full(len(asked), UNKNOWN_ID, np.int32)
        if len(known) and len(asked):
            place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            near = np.flatnonzero(known[place] == asked)
            same = pc.equal(tokens.flatten().take(pa.array(near)), words.take(pa.array(place[near])))
            near = near[same.to_numpy(zero_copy_only=False)]
            found[near] = ids[place[near]]
        sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int32)))

    return encode


def padded(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("token_ids", pad_tokens(F.col("token_ids"), width))


def _flat(exploded: DataFrame, column: str = "term") -> DataFrame:
    """Drop the empty row an outer generator leaves.

    An inner generator would make Spark infer a filter on the array and push it below the
    projections that build it, computing the whole array again.
    """
    return exploded.where(F.col(column).isNotNull())


def term_table(df: DataFrame, block: str, make: Callable[..., DataFrame]) -> DataFrame:
    """Long ``(sentence_id, block, term, tf)``."""
    counted = with_term_counts(make(df.select(ID, TEXT), TEXT, "_terms"), "_terms", "_counts")
    return _flat(counted.select(ID, F.lit(block).alias("block"), F.inline_outer("_counts")))


def _cut(df: DataFrame, block: str, make: Callable[..., DataFrame]) -> DataFrame:
    """Adds ``_terms`` of a block and their 64-bit keys."""
    cut = make(df.withColumn(TEXT, F.coalesce(F.col(TEXT), F.lit(""))), TEXT, "_terms")
    return cut.withColumn("_keys", F.transform("_terms", lambda t: F.xxhash64(F.lit(block), t)))


def fit_idf(train: DataFrame, representation: str) -> DataFrame:
    """Written ``(block, key, df, idf)`` with smooth idf over the train rows."""
    found = None
    for block, make in BLOCKS[representation].items():
        keys = F.explode_outer(F.array_distinct("_keys")).alias("key")
        part = _flat(_cut(train.select(TEXT), block, make).select(F.lit(block).alias("block"), keys), "key")
        found = part if found is None else found.unionAll(part)
    counts = found.groupBy("block", "key").agg(F.count(F.lit(1)).alias("df"))
    return materialise(with_idf(counts, train.count()), f"idf-{representation}")


def _keyed(df: DataFrame, block: str, make: Callable[..., DataFrame]) -> DataFrame:
    """Adds ``_t``, ``_n`` and ``_k``: the distinct terms of a block, their counts and keys."""
    carried = df.drop(TEXT).columns
    counted = with_term_counts(_cut(df, block, make).drop("_keys"), "_terms", "_counts")
    return counted.select(
        *carried, F.transform("_counts", lambda c: c["term"]).alias("_t"), F.transform("_counts", lambda c: c["tf"]).alias("_n"),
        F.transform("_counts", lambda c: F.xxhash64(F.lit(block), c["term"])).alias("_k"),
    )


def weigh_terms(df: DataFrame, idf: DataFrame, representation: str) -> DataFrame:
    """``(sentence_id, block, term, weight)``: sublinear tf times idf, L2 norm 1 per block.

    Terms missing from a written ``idf`` drop out. Counts are one array per row; the idf of the ``LOOKUP_ROWS``
    most widespread terms of a block is looked up in the task. In a larger table the rest meets the rows' rare
    terms in a join; a written copy of the texts then takes their weights by row number and is cut once more. The norm
    is taken before the array is opened.
    """
    stacked, numbered = None, None
    for block, make in BLOCKS[representation].items():
        head, tail = terms.head_and_tail(idf.where(F.col("block") == block), terms.LOOKUP_ROWS)
        names = [("_k", "_n", "_w")]
        if tail is None:
            weighed = weights(_keyed(df.select(ID, TEXT), block, make), head, names, unit=True)
        else:
            if numbered is None:
                numbered = materialise(df.select(ID, TEXT, F.monotonically_increasing_id().alias("_row")), "numbered")
            cells = weights(_keyed(numbered.select("_row", TEXT), block, make), head, names)
            met = numbered.join(terms.tail_weights(cells, tail, "_row", "_k", "_n", "_w"), "_row", "left")
            again = weights(_keyed(met, block, make), head, names)
            weighed = again.withColumn("_w", terms.unit_with_tail("_w", "_at", "_raw"))
        pairs = F.arrays_zip(F.col("_t").alias("term"), F.col("_w").alias("weight"))
        opened = weighed.select(ID, F.lit(block).alias("block"), F.inline_outer(pairs))
        part = opened.where(F.col("weight").isNotNull())
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def tfidf_weights(df: DataFrame, train: DataFrame, representation: str) -> DataFrame:
    """Weights of ``df`` under the vocabulary and idf of ``train``."""
    return weigh_terms(df, fit_idf(train, representation), representation)


def feature_union(df: DataFrame, train: DataFrame, representation: str = "word_char") -> DataFrame:
    """All blocks in one term space: terms carry their block as a prefix."""
    weights = tfidf_weights(df, train, representation)
    return weights.select(
        ID, F.concat("block", F.lit(":"), "term").alias("term"), "weight"
    )


def feature_counts(train: DataFrame) -> DataFrame:
    """Distinct terms of the train rows by representation; a linear model has one parameter more
    (intercept).

    The widest representation holds the terms of the others - unigrams are its word terms
    without a blank - so each text is cut up once. A term is 128 bits of hash; they are made distinct in
    each task before any of them is shuffled.
    """
    blocks = BLOCKS["word_char"]
    cut = blocks["c"](blocks["w"](train.select(TEXT), TEXT, "_w"), TEXT, "_c")

    def digests(block: str, kind: Callable[[Column], Column]) -> Column:
        return F.transform(f"_{block}", lambda t: F.struct(
            kind(t).alias("kind"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(block), t).alias("h2")
        ))

    words = digests("w", lambda t: F.contains(t, F.lit(" ")).cast("tinyint"))
    pieces = digests("c", lambda t: F.lit(2).cast("tinyint"))
    flat = _flat(cut.select(F.inline_outer(F.concat(words, pieces))), "kind")
    terms = flat.groupBy("kind", "h1", "h2").agg(F.lit(1).alias("one"))
    counts = terms.agg(
        F.count_if(F.col("kind") == 0).alias("word_unigram"),
        F.count_if(F.col("kind") < 2).alias("word_bigram"),
        F.count(F.lit(1)).alias("word_char"),
    )
    each = F.array(*[F.struct(F.lit(n).alias("representation"), F.col(n).alias("feature_count")) for n in BLOCKS])
    return counts.select(F.inline(each)).withColumn("parameter_count", F.col("feature_count") + 1)
