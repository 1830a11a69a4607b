"""Text functions against Python's own definitions."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.functions.tokens import (
    pad_tokens,
    regex_tokens,
    with_char_ngrams,
    with_term_counts,
    with_word_ngrams,
)
from assayline.operators import features, terms

SAMPLES = [
    "Ｗｉｄｅ  ＬＥＴＴＥＲＳ  here",
    "upper\x0b LOWER　mixed",
    "Straße ﬁne İstanbul ΣΑΣ Ⅷ ½",
    "  a b\x1cc\x85d\xa0e  ",
    "don't it’s o'clock' x1y2",
    "a ab abc abcd abcde abcdef",
    "naïve café Ångström é कि שׁ",
    "emoji 😀😀x y😀 z",
    "_under_ score 9 42 ²³ x",
    "",
    "   ",
    None,
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(i), value) for i, value in enumerate(SAMPLES)]
    return spark.createDataFrame(data, "sentence_id string, text string").repartition(3).cache()


def _by_id(frame, column):
    return {int(r["sentence_id"]): r[column] for r in frame.collect()}


def test_text_key(rows):
    got = _by_id(rows.withColumn("k", T.text_key(F.col("text"))), "k")
    for i, value in enumerate(SAMPLES):
        expected = None
        if value is not None:
            expected = " ".join(unicodedata.normalize("NFKC", value).casefold().split())
        assert got[i] == expected


def test_strip_blank_and_words(rows):
    frame = rows.select(
        "sentence_id",
        T.strip(F.col("text")).alias("s"),
        T.is_blank(F.col("text")).alias("b"),
        T.count_words(F.col("text")).alias("w"),
    )
    for row in frame.collect():
        value = SAMPLES[int(row["sentence_id"])]
        if value is None:
            assert row["s"] is None
            continue
        assert (row["s"], row["b"], row["w"]) == (
            value.strip(), not value.strip(), len(value.split())
        )


def _folded(value):
    decomposed = unicodedata.normalize("NFKD", value.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def test_strip_accents(rows):
    got = _by_id(rows.withColumn("a", T.strip_accents(F.lower("text"))), "a")
    assert all(got[i] == _folded(v) for i, v in enumerate(SAMPLES) if v is not None)


def _char_grams(value):
    out = []
    for word in _folded(value).split():
        padded = f" {word} "
        for n in (3, 4, 5):
            if len(padded) <= n:
                out.append(padded)
                break
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def test_char_ngrams(rows):
    got = _by_id(with_char_ngrams(rows, "text", "g"), "g")
    for i, value in enumerate(SAMPLES):
        if value is not None:
            assert Counter(got[i]) == Counter(_char_grams(value))


def test_word_ngrams(rows):
    got = _by_id(with_word_ngrams(rows, "text", "g", 1, 2), "g")
    for i, value in enumerate(SAMPLES):
        if value is not None:
            words = re.findall(r"(?u)\b\w\w+\b", _folded(value))
            assert got[i] == words + [" ".join(pair) for pair in zip(words, words[1:])]


def test_regex_tokens(rows):
    got = _by_id(rows.withColumn("t", regex_tokens(F.col("text"))), "t")
    pattern = re.compile(r"[a-z0-9]+(?:['’][a-z0-9]+)?")
    assert all(got[i] == pattern.findall(v.lower()) for i, v in enumerate(SAMPLES) if v is not None)


def test_term_counts(spark):
    lists = [["b", "a", "b"], [], ["x"], ["q"] * 5 + ["p"] * 3]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, t array<string>")
    for row in with_term_counts(frame, "t", "c").collect():
        assert {e["term"]: e["tf"] for e in row["c"]} == dict(Counter(lists[row["i"]]))


def test_vocabulary_and_encoding(spark):
    train = spark.createDataFrame([("1", "b a b c"), ("2", "a b")], "sentence_id string, text string")
    vocab = features.vocabulary(train, 4)
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"b": 2, "a": 3}
    rows = spark.createDataFrame(
        [("1", "A b zzz a"), ("2", "!!"), ("3", None)], "sentence_id string, text string"
    )
    for shipped in (10, 1):  # in-task lookup, then the join used for large vocabularies
        got = _by_id(features.encode_text(rows, vocab, shipped=shipped), "token_ids")
        assert got == {1: [3, 2, 1, 3], 2: [1], 3: [1]}
    assert _by_id(features.encode_text(rows, vocab, 2), "token_ids")[1] == [3, 2]
    padded = features.padded(features.encode_text(rows, vocab), 3)
    assert _by_id(padded, "token_ids") == {1: [3, 2, 1], 2: [1, 0, 0], 3: [1, 0, 0]}
    with pytest.raises(ValueError):
        features.vocabulary(train, 1)
    with pytest.raises(ValueError):
        features.encode_text(rows, vocab, 0)
    assert pad_tokens is not None


def test_weights_move_no_row(spark):
    """Neither the rows nor their terms are shuffled once idf is there."""
    data = [(str(i), f"common w{i} w{i % 3}") for i in range(12)] + [("x", None), ("y", "")]
    rows = spark.createDataFrame(data, "sentence_id string, text string")
    idf = features.fit_idf(rows, "word_char")
    weighed = features.weigh_terms(rows, idf, "word_char")
    assert "Exchange" not in weighed._jdf.queryExecution().executedPlan().toString()
    norms = weighed.groupBy("sentence_id", "block").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 24 and all(abs(r.n - 1) < 1e-12 for r in norms)


def test_encoding_is_the_same_on_both_sides_of_the_size_switch(spark):
    rows = [("1", "a b"), ("1", "a b"), ("2", ""), ("2", "c a c"), (None, "b")]
    frame = spark.createDataFrame(rows, "sentence_id string, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, token_id int")
    sides = [
        sorted(map(repr, features.encode_text(frame, vocab, shipped=n).select("sentence_id", "text", "token_ids").collect()))
        for n in (10, 1)
    ]
    assert sides[0] == sides[1] and len(sides[0]) == 5


def test_a_large_idf_table_meets_the_rare_terms_in_a_join(spark, monkeypatch):
    """No more than the head travels to the tasks; repeated and null ids, null and empty texts and unknown terms weigh the same."""
    data = [(str(i % 9), f"common w{i} w{i % 3} only{i} only{i}") for i in range(12)]
    data += [(None, "common w1"), (None, "w2 w2"), ("x", None), ("y", ""), ("z", "zzz qqq"), ("0", data[0][1])]
    rows = spark.createDataFrame(data, "sentence_id string, text string")
    idf = features.fit_idf(rows.where("text not like 'zzz%'"), "word_char")
    sent = []
    lookup = terms.shards
    monkeypatch.setattr(terms, "shards", lambda table, columns: (sent.append(table.count()), lookup(table, columns))[1])
    get = lambda: sorted((str(r[0]), r[1], r[2], round(r[3], 9)) for r in features.weigh_terms(rows, idf, "word_char").collect())
    whole = get()
    for head in (30, 1):
        monkeypatch.setattr(terms, "LOOKUP_ROWS", head)
        sent.clear()
        assert get() == whole
        assert max(sent) <= head


def test_pieces_of_all_rows_are_counted_as_row_by_row_with_few_rows_shuffled(spark, monkeypatch):
    data = [("1", t) for t in SAMPLES] + [("1", SAMPLES[3]), (None, "ab ab  ab\n"), ("n", None), ("e", ""), ("b", " \t ")]
    rows = spark.createDataFrame(data, "sentence_id string, text string")
    one = features.term_table(rows, "c", features.BLOCKS["word_char"]["c"])
    want = sorted(map(tuple, one.groupBy("term").agg(F.sum("tf"), F.count(F.lit(1))).collect()))
    for limit in (1 << 18, 3):
        monkeypatch.setattr(terms, "CHUNK_WORDS", limit)
        assert sorted(map(tuple, terms.piece_totals(rows).collect())) == want
    many = terms._piece_totals(pa.array(["hello", "there"] * 50), np.repeat(np.arange(50), 2), 3, 5)
    assert many.num_rows == len(set(many.column(0).to_pylist())) and set(many.column("df").to_pylist()) == {50}
