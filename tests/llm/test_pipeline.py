"""The pipeline on a small corpus with planted cases, and the registered queries' SQL."""

import random

import corpus_pipeline
import oracle
import pytest
from test_dedup import brute_components, brute_fingerprint

from assayline.llm import queries
from assayline.session import materialise


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(12)
    words = [f"{a}{b}" for a in ("an", "or", "the", "ou", "ti") for b in ("st", "re", "nd", "ea", "ly", "wh", "ble")]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    items = [(n, prose(40)) for n in range(5)]
    rows = [(n, prose(draw.randint(60, 150))) for n in range(400)]
    toxic = [n for n in range(400) if n % 8 == 0]
    for n in toxic:
        rows[n] = (n, rows[n][1] + " grunk " + prose(20))
    copies = {500 + n: n for n in (1, 2, 3)}
    rows += [(c, rows[n][1]) for c, n in copies.items()]
    near = {510 + n: n for n in (4, 5, 6)}
    rows += [(c, " ".join(["changed", *rows[n][1].split()[1:]])) for c, n in near.items()]
    leaks = [520 + n for n, _ in items]
    rows += [(520 + n, prose(30) + " " + text.upper() + ", " + prose(30)) for n, text in items]
    line = "this very line is in two of the documents"
    rows += [(530, prose(50) + "\n" + line), (531, prose(50) + "\n  " + line.upper())]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(n, t, "en", "src", len(t)) for n, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, 1, int(n in toxic)) for n in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, set(toxic), copies, near, set(leaks)


def test_every_stage_takes_effect(spark, corpus):
    folder, rows, toxic, copies, near, leaks = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept.append(docs)
    every = {n for n, _ in rows}
    after = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert len(every - toxic - after[0]) <= 2 and len(after[0] & toxic) <= 2
    assert after[1] == after[0]
    text = {r.doc_id: r for r in kept[1].collect()}
    assert text[531].text == dict(rows)[531].split("\n")[0] and text[531].n_chars == len(text[531].text)
    assert text[530].text == dict(rows)[530]
    # an exact copy of one line has lost it; of the documents left empty one stays
    assert all(text[c].text == "" for c in copies) and len(after[2] & set(copies)) == 1
    prints = {n: brute_fingerprint(row.text, 3) for n, row in text.items()}
    of, least = brute_components(set(prints.values()), 2), {}
    for n, fp in prints.items():
        least[of[fp]] = min(n, least.get(of[fp], n))
    assert after[2] == set(least.values()) and any(c not in after[2] for c in near)
    assert after[3] == after[2] - leaks
    packed = kept[4].collect()
    assert {r.doc_id for r in packed} == after[3]
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in run) == sorted(tuple(r)[:5] for r in packed)


def test_columns_of_any_name_come_through(spark, corpus):
    folder = corpus[0]
    names = ["score", "flagged", "digest", "dropped", "kept", "n_lines", "n_dropped", "fp", "item_id", "__lang", "length"]
    names += ["__score", "__flagged", "__key1", "__key2", "row", "key1", "salt", "score2"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 200 or doc_id > 500")
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns
    rows = docs.collect()
    assert len(rows) > 20 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_an_empty_corpus_passes_through(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, folder, name):
    rows, difference = oracle.compare(spark, oracle.connect(folder), queries.QUERIES[name], queries.ORACLES[name], folder)
    assert difference is None
    assert rows > 0
