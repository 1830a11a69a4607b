"""Ranked search against scores of all pairs of a document and a query."""

import math
import re
import string

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from assayline.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, asked, count):
    cut = [(key, terms(text)) for key, text in docs]
    n_docs, length = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    df = {}
    for _, t in cut:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    wanted = {}
    for item, text in asked:
        wanted.setdefault(item, set()).update(terms(text))
    found = []
    for item, words in wanted.items():
        scored = []
        for key, t in cut:
            score = 0
            for term in words & set(t):
                tf = t.count(term)
                m = 100 - 50 + (50 * len(t) * n_docs) // length
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, key is None, key))
        for rank, (score, _, key) in enumerate(sorted(scored)[:count], 1):
            found.append((item, rank, key, -score))
    return sorted(found, key=repr)


def searched(spark, docs, asked, count):
    given = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    items = spark.createDataFrame(asked, "item_id bigint, text string").withColumn("score", F.lit(1))
    return sorted(map(tuple, lexical.search(given, items, count).collect()), key=repr)


def test_query_equals_sql(spark, folder):
    rows, difference = compare(
        spark, connect(folder), queries.op13_lexical_search, queries.ORACLES["op13_lexical_search"], folder
    )
    assert rows and difference is None


def corpus(seed, size):
    pick = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "über", "x1", "中文"]
    odds = 1 / np.arange(1, len(words) + 1)
    odds /= odds.sum()
    docs = []
    for key in range(size):
        held = pick.choice(words, pick.integers(0, 60), p=odds)
        docs.append((key, pick.choice([" ", "-", "\n", "_."]).join(held).replace("w1", "W1")))
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # copies
    docs += [(2000, None), (2001, ""), (2002, "?!"), (None, docs[6][1]), (7, docs[7][1]), (7, docs[8][1])]
    asked = [(i, " ".join(pick.choice(words, pick.integers(1, 12)))) for i in range(12)]
    return docs, [*asked, (3, "w2 w4"), (50, None), (51, "unseen"), (None, "w3, w5!")]


@pytest.mark.parametrize("shard,block,query_bytes", [(8192, 128, 1 << 22), (16, 4, 64)])
def test_blocks_and_shards_of_any_size(spark, monkeypatch, shard, block, query_bytes):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)
    docs, asked = corpus(1, 150)
    assert searched(spark, docs, asked, 10) == by_hand(docs, asked, 10)


def test_bounds_keep_blocks_closed(monkeypatch):
    """A rare term's candidates open only the blocks of common terms they may lie in."""
    import pyarrow as pa

    monkeypatch.setattr(lexical, "BLOCK", 4)
    docs = [(i, "common " * (1 + i % 3) + ("rare" if i in (3, 90) else f"filler{i}")) for i in range(128)]
    build = lexical._index({b"common": 0, b"rare": 1})
    batch = pa.record_batch({"doc_id": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs])})
    (index,) = build(iter([batch]))
    lists = index.column("lists")[0].as_py()
    corpus_facts = lexical.Corpus(128, int(index.column("terms")[0].as_py()))
    weights = {x["term"]: corpus_facts.weight(x["df"]) for x in lists}
    shard = lexical._Lists(np.frombuffer(index.column("sizes")[0].as_py(), np.int64), lists, weights, corpus_facts)
    bounds = {t: int(x[3].max()) for t, x in shard.lists.items()}
    at, _ = shard.search(sorted((b, t) for t, b in bounds.items()), bounds[0] + 1)
    assert at.tolist() == [3, 90]
    assert sum(term == 0 for term, _ in shard.open) <= 2 < len(shard.lists[0][0])


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == []
    assert searched(spark, [(1, "a")], [], 5) == []
    assert searched(spark, [(1, None)], [(1, "a")], 5) == []


def test_very_long_text_and_integers_of_any_size(spark):
    docs = [(1, "a b " * 300_000), (2, "a"), (3, "b c")]
    assert searched(spark, docs, [(1, "a c")], 5) == by_hand(docs, [(1, "a c")], 5)
    facts = lexical.Corpus(10**12, 10**15)
    assert facts.norms(np.array([10**9, 1]))[0] == 50 + 50 * 10**9 * 10**12 // 10**15
