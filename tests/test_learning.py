"""Fits against a direct solve, selection without test data, saving, scoring, whole run."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayline.operators import features, learn, score, solver, terms
from assayline.plans.run import run_benchmark
from assayline.schema import IntegrityError
from assayline.sources import tables
from assayline.streaming.scoring import score_stream

GOOD, BAD = "lovely great fine warm".split(), "awful poor cold broken".split()
SCHEMA = "sentence_id string, source string, text string, label bigint, split string"


def _text(i, label):
    words = GOOD if label else BAD
    return f"{words[i % 4]} {words[(i + 1) % 4]} item number{i}"


def _rows(test_word=""):
    rows = []
    for split, count in (("train", 16), ("validation", 8), ("test", 4)):
        for i in range(count):
            text = _text(i, i % 2) + (test_word if split == "test" else "") + f" {split}word{i}"
            label = None if split == "test" else i % 2
            rows.append((f"{split}{i:02d}", "ab"[i % 2], text, label, split))
    return rows


@pytest.fixture(scope="module")
def assigned(spark):
    return spark.createDataFrame(_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def rung(assigned):
    return learn.candidate_search(assigned)


def _newton(x, y, c):
    w = np.zeros(x.shape[1])
    for _ in range(50):  # on |w|^2 / 2 + C * sum(log loss)
        p = 1 / (1 + np.exp(-x @ w))
        hessian = np.eye(x.shape[1]) + c * (x * (p * (1 - p))[:, None]).T @ x
        w -= np.linalg.solve(hessian, w + c * x.T @ (p - y))
    return w


def test_logistic_equals_direct_solve(spark):
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(80, 5)), np.ones((80, 1))])
    y = (x[:, 0] + rng.normal(size=80) > 0.5).astype(int)
    frame = spark.createDataFrame([(int(y[i]), x[i, :-1].tolist()) for i in range(80)], "label int, a array<double>")
    models = learn.fit_vectors(frame.repartition(3), "a", [0.5, 2.0], tolerance=1e-9)
    for c, model in models.items():
        assert np.allclose(model.coefficients, _newton(x, y, c), atol=1e-6)


def _sparse_rows(spark, features, rows=300, seed=5):
    """Rows of ten features each, and the dense matrix of them with the constant."""
    rng = np.random.default_rng(seed)
    x = np.zeros((rows, features + 1))
    for row in x:
        row[rng.choice(features, 10, replace=False)] = rng.random(10)
    x[:, -1] = 1.0
    y = (x @ rng.normal(size=features + 1) * 2 + rng.normal(size=rows) > 0).astype(float)
    data = [("d", float(t), np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r, t in zip(x, y)]
    return spark.createDataFrame(data, solver.ROWS), x, y


def _objective(x, y, w, c):
    margin = x @ w
    return w @ w / 2 + c * np.logaddexp(0, np.where(y == 1, -margin, margin)).sum()


def test_default_tolerance_is_near_a_tight_solve(spark, monkeypatch):
    """Weights within 1 % of their length, the objective within 1e-5 of its least value; ranges and
    partitions change nothing."""
    monkeypatch.setattr(solver, "RANGE_FEATURES", 40)
    rows, x, y = _sparse_rows(spark, 100, 150)
    for parts in (1, 5):
        weights, _ = solver.fit_designs(rows.repartition(parts), ["d"], [0.5, 2.0], learn.SOLVER_TOLERANCE, 2_000)
        found = np.array([r["weights"] for r in weights.orderBy("key").collect()]).T
        for w, c in zip(found, (0.5, 2.0)):
            tight = _newton(x, y, c)
            least = _objective(x, y, tight, c)
            assert np.linalg.norm(w - tight) < 0.01 * np.linalg.norm(tight)
            assert _objective(x, y, w, c) - least < 1e-5 * least


def test_the_driver_gets_numbers_only(spark, monkeypatch):
    """What comes back in a pass is as large for many features and partitions as for few."""
    sizes = {}
    added = solver._added
    for features, parts in ((50, 2), (2_000, 16)):
        seen = []
        monkeypatch.setattr(solver, "_added", lambda a, b, seen=seen: seen.append(added(a, b)) or seen[-1])
        rows, _, _ = _sparse_rows(spark, features, 100)
        solver.fit_designs(rows.repartition(parts), ["d"], [1.0], 1e-2, 20)
        sizes[features] = max(sum(np.size(v) for v in found.values()) for found in seen if found)
    assert sizes[50] == sizes[2_000] < 150


def test_term_weights_are_the_relational_weights(spark, assigned):
    train = assigned.where("split = 'train'")
    store, table = learn.fit_term_space(train)
    rows = terms.design_rows(store, table, ["word_unigram", "word_char"], "label")
    for name in ("word_unigram", "word_char"):
        got = sorted(sorted(np.round(r["values"], 9)) for r in rows.where(F.col("design") == name).collect())
        long = features.tfidf_weights(train, train, name).groupBy("sentence_id").agg(F.collect_list("weight").alias("w"))
        assert got == sorted(sorted(np.round([*r["w"], 1.0], 9)) for r in long.collect())
    counts = {r.representation: r.feature_count for r in features.feature_counts(train).collect()}
    assert counts == terms.feature_numbers(table)
    bounded = learn.fit_term_space(train, "u", max_terms=3)[1]
    item = spark.range(1).select(terms.word_key(F.lit("item")).alias("key")).first()["key"]
    assert bounded.count() == 3 and bounded.where(F.col("key") == item).count() == 1
    other = [terms.word_key(F.lit(f"{s}word{i}")) for s in ("validation", "test") for i in range(4)]
    keys = spark.range(1).select(F.explode(F.array(*other)).alias("key"))
    assert table.join(keys, "key").count() == 0


def test_terms_of_one_row_are_one_feature_of_the_fit_with_the_same_weights(spark, assigned):
    """Repeated and null texts included; the fit sees one feature per row in place of all its own terms."""
    train = assigned.where("split = 'train'")
    train = train.unionByName(train.limit(3)).unionByName(
        spark.createDataFrame([("n", "a", None, 0, "train"), ("o", "b", "seen nowhere else", 1, "train")], SCHEMA))
    store, table = learn.fit_term_space(train)
    idf = float(np.log((1 + store.count()) / 2) + 1)
    plain, merged = (terms.design_rows(store, table, ["word_char"], "label", x) for x in (None, idf))
    count = lambda rows: rows.select(F.explode("keys")).distinct().count()
    lone = merged.where(F.size("singles") > 0).count()
    assert lone and count(merged) == 1 + table.where("df > 1").count() + lone < count(plain)
    found = [
        learn.fit_term_models(store, table, ["word_unigram", "word_char"], [0.5, 2.0], 1e-8, whole) for whole in (False, True)
    ]
    for name in found[0]:
        a, b = ({(r.kind, r.key): r.weights for r in f[name].table.collect()} for f in found)
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)
        assert np.allclose(found[0][name].intercepts, found[1][name].intercepts, atol=1e-5)


def test_a_fit_leaves_no_checkpoint_and_no_shuffle_behind(spark):
    import glob
    from urllib.parse import urlparse
    rows, _, _ = _sparse_rows(spark, 400)
    context = spark.sparkContext
    before = set(glob.glob(f"{urlparse(context.getCheckpointDir() or '').path}/rdd-*"))
    sizes = []
    judged = solver.Fit.react

    def react(self, facts, loss):
        sizes.append(context._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size())
        return judged(self, facts, loss)

    solver.Fit.react = react
    try:
        _, passes = solver.fit_designs(rows.repartition(2), ["d"], [1.0], 1e-9, 60)
    finally:
        solver.Fit.react = judged
    assert passes > 2 * solver.CHECKPOINT_PASSES
    assert not set(glob.glob(f"{urlparse(context.getCheckpointDir()).path}/rdd-*")) - before
    assert max(sizes[8:]) <= 2 * max(sizes[:8])  # files of two shuffles a pass would make it three times as many


def test_blocks_multiply_in_chunks_of_features(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((9, 40)) * (rng.random((9, 40)) < 0.3)
    x[:, 0] = 1.0
    held = [np.flatnonzero(r) for r in x]
    packed = {
        "design": "d", "offsets": np.cumsum([0] + [len(h) for h in held]).tobytes(), "keys": np.concatenate(held).tobytes(),
        "values": np.concatenate([r[h] for r, h in zip(x, held)]).tobytes(), "target": np.ones(9).tobytes(),
    }
    (number, (_, found)), = solver._blocks(4, [packed, packed])
    block = solver.Block(*found["d"])
    dense = np.vstack([x, x])[:, (block.keys * np.uint64(solver._GATHER)).astype(int)]
    vectors, rows = rng.random((2, len(block.keys))), rng.random((3, 18))
    for entries in (1, 7, 1 << 18):
        monkeypatch.setattr(solver, "CHUNK_ENTRIES", entries)
        assert np.allclose(block.products(vectors), vectors @ dense.T) and np.allclose(block.gradients(rows), rows @ dense)
    assert number == 4 and (np.diff(block.keys.astype(float)) > 0).all()


def test_a_fit_persists_its_rows_and_routes_and_no_state(spark, monkeypatch):
    rows, _, _ = _sparse_rows(spark, 60, 80)
    persisted, judged = [], solver.Fit.react
    before = spark.sparkContext._jsc.getPersistentRDDs().size()

    def react(self, facts, loss):
        persisted.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return judged(self, facts, loss)

    monkeypatch.setattr(solver.Fit, "react", react)
    solver.fit_designs(rows.repartition(2), ["d"], [1.0], 1e-3, 20)
    assert len(persisted) > 5 and max(persisted) <= before + 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_a_fit_deals_its_rows_out_by_entries(spark, assigned, monkeypatch):
    """However few partitions a store has, no task of a fit holds much more than ``FIT_ENTRIES``; the weights are the same."""
    store, table = learn.fit_term_space(assigned.where("split = 'train'").coalesce(1), "ub")
    sizes, fit = [], learn.fit_designs

    def fitted(rows, *rest):
        sizes.append([sum(len(r["keys"]) for r in part) for part in rows.rdd.glom().collect()])
        return fit(rows, *rest)

    monkeypatch.setattr(learn, "fit_designs", fitted)
    found = []
    for entries in (8_000_000, 20):
        monkeypatch.setattr(learn, "FIT_ENTRIES", entries)
        model = learn.fit_term_models(store, table, ["word_unigram", "word_bigram"], [1.0], 1e-8)["word_bigram"]
        found.append({(r.kind, r.key): r.weights[0] for r in model.table.collect()})
    assert max(sizes[0]) > 200 > 100 > max(sizes[1])
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-6 for k in found[0])


def test_any_number_of_shards_gives_the_same(spark, assigned, monkeypatch):
    train = assigned.where("split = 'train'")
    whole = {}
    for size in (4_000_000, 7):
        monkeypatch.setattr(terms, "SHARD_ROWS", size)
        monkeypatch.setattr(terms, "HEAD_ROWS", size)
        table = features.tfidf_weights(assigned, train, "word_bigram").collect()
        store, space = learn.fit_term_space(train, "ub")
        model = learn.fit_term_models(store, space, ["word_bigram"], [1.0, 2.0])["word_bigram"]
        scored = model.probabilities(terms.term_store(assigned, ["sentence_id"], "ub"), "p").collect()
        whole[size] = ({(r[0], r[2]): round(r[3], 9) for r in table}, {r["sentence_id"]: np.round(r["p"], 7).tolist() for r in scored})
    assert whole[7] == whole[4_000_000]


@pytest.mark.parametrize("head", [1, 40])
def test_rare_terms_of_a_model_meet_the_rows_in_a_join(spark, rung, assigned, monkeypatch, head):
    """Repeated rows, a null, an empty and an unknown text score the same with any head."""
    more = spark.createDataFrame([("n", "s", None, 0, "test"), ("e", "s", "", 0, "test"), ("u", "s", "zzz", 0, "test")], SCHEMA)
    rows = assigned.unionByName(assigned.limit(5)).unionByName(more)
    get = lambda: sorted((x["sentence_id"], round(x["probability"], 9)) for x in rung.score(rows).collect())
    whole = get()
    monkeypatch.setattr(terms, "HEAD_ROWS", head)
    assert get() == whole
    table = rung.model.table
    kept, rest = terms._head_and_tail(table)
    assert kept.count() + rest.count() == table.count()


def test_search_has_nine_candidates_and_one_winner(rung, assigned):
    rows = rung.search.orderBy("candidate_index").collect()
    assert [r["candidate"] for r in rows[:3]] == ["word_unigram_c0.5", "word_unigram_c1", "word_unigram_c2"]
    assert len(rows) == 9 and sum(r["selected"] for r in rows) == 1
    best = max(rows, key=lambda r: (r["validation_macro_f1"], -r["candidate_index"]))
    assert best["selected"] and best["validation_macro_f1"] > 0.9


def test_test_rows_do_not_influence_selection(spark, rung):
    other = learn.candidate_search(spark.createDataFrame(_rows(" marker"), SCHEMA))
    table = lambda r: [tuple(x) for x in r.search.drop("fit_seconds").orderBy("candidate_index").collect()]
    assert table(other) == table(rung)
    weights = lambda r: {x["key"]: x["weights"][0] for x in r.model.table.collect()}
    assert weights(other) == pytest.approx(weights(rung), abs=1e-9)


def test_bundle_round_trip(spark, rung, assigned, tmp_path):
    path = learn.save_rung(rung, str(tmp_path / "model"), spark)
    again = learn.load_rung(path, learn.TFIDF_NAME, spark)
    get = lambda r: [x["probability"] for x in r.score(assigned).orderBy("sentence_id").collect()]
    assert np.allclose(get(again), get(rung), atol=1e-7)
    with pytest.raises(IntegrityError):
        learn.load_rung(path, learn.EMBEDDING_NAME, spark)


def test_score_batch(spark, rung):
    rows = spark.createDataFrame(
        [("x", "lovely great"), ("y", "awful poor"), ("z", "ünknown")], "sentence_id string, text string")
    scored = score.score_batch(rows, rung)
    assert tuple(scored.columns) == score.OUTPUT_COLUMNS
    got = {r["sentence_id"]: r for r in scored.collect()}
    assert got["x"]["predicted_sentiment"] == "positive" and got["y"]["predicted_label"] == 0
    with pytest.raises(ValueError):
        score.score_batch(rows.withColumn("text", F.lit(" ")), rung)
    with pytest.raises(ValueError, match="unknown model"):
        score.score_batch(rows, learn.Rung("nobody", None, 0.0, 0))


def test_score_file_with_given_and_default_ids(spark, rung, tmp_path):
    saved = learn.save_rung(rung, str(tmp_path / "model"), spark)
    source, target = tmp_path / "in.csv", str(tmp_path / "scores")
    texts = ["lovely great", 'awful, "poor"\nworse', "ünknown"]
    cells = ['"' + t.replace('"', '""') + '"' for t in texts]
    batch = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sentence_id string, text string")
    expected = [tuple(r)[1:] for r in score.score_batch(batch, rung).orderBy("sentence_id").collect()]
    for ids, head in (([f"input_{i:06d}" for i in range(3)], "text"), (["c", "b", "a"], "note,text,sentence_id")):
        lines = cells if head == "text" else [f"{c[1]},{c},{i}" for c, i in zip(cells, ids)]
        source.write_text("\n".join([head, *lines]) + "\n")
        assert score.score_file(spark, str(source), target, saved, rung.name) == target
        rows = {r[0]: tuple(r)[1:] for r in score.read_scores(spark, target).collect()}
        assert list(rows) and set(rows) == set(ids)
        for i, row in zip(ids, expected):
            assert rows[i][0] == pytest.approx(row[0], abs=1e-12) and rows[i][1:] == row[1:]
    with pytest.raises(FileExistsError):
        score.score_file(spark, str(source), target, saved, rung.name, replace=False)


@pytest.mark.parametrize("body, rule", [
    ("sentence_id,text\n", "non_empty"),
    ("sentence_id,text\na,x\nb, \n", "text_present"),
    ("sentence_id,text\na,x\nb,\n", "text_present"),
    ("sentence_id,text\na,x\n,y\n", "id_present"),
    ("sentence_id,text\na,x\nb,y\na,z\n", "id_unique"),
    ("sentence_id,body\na,x\n", "no column 'text'"),
])
def test_score_file_publishes_nothing_of_a_bad_input(spark, rung, tmp_path, body, rule):
    saved = learn.save_rung(rung, str(tmp_path / "model"), spark)
    source, folder = tmp_path / "in.csv", tmp_path / "out"
    target = str(folder / "scores")
    source.write_text("text\nlovely great\n")
    score.score_file(spark, str(source), target, saved, rung.name, "csv")
    before = score.read_scores(spark, target).collect()
    source.write_text(body)
    with pytest.raises(ValueError, match=rule):
        score.score_file(spark, str(source), target, saved, rung.name)
    assert score.read_scores(spark, target).collect() == before
    assert [p.name for p in folder.iterdir() if not p.name.startswith(".")] == ["scores"]
    with pytest.raises(ValueError, match="unknown model"):
        score.score_file(spark, str(source), target, saved, "nobody")


def test_score_file_with_given_vectors(spark, tmp_path):
    name = learn.PRETRAINED_NAME
    saved = learn.save_rung(learn.Rung(name, learn.VectorModel([2.0, -1.0, 0.5], "embedding"), 0.0, 3), str(tmp_path / "m"), spark)
    rows = spark.createDataFrame([("a", "x", [1.0, 1.0]), ("b", "y", [0.0, 3.0])], "sentence_id string, text string, embedding array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    target = score.score_file(spark, str(tmp_path / "in"), str(tmp_path / "out"), saved, name, "parquet")
    got = {r[0]: r[1] for r in score.read_scores(spark, target, "parquet").collect()}
    assert got == pytest.approx({"a": 1 / (1 + np.exp(-1.5)), "b": 1 / (1 + np.exp(2.5))})
    rows.select("sentence_id", "text", F.when(F.col("sentence_id") == "a", F.col("embedding")).alias("embedding")).write.parquet(str(tmp_path / "holes"))
    with pytest.raises(PySparkException, match="invalid probability"):
        score.score_file(spark, str(tmp_path / "holes"), str(tmp_path / "none"), saved, name, "parquet")
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("none")]


def test_score_with_any_python_model(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "x")], "sentence_id string, text string")

    def load():
        return lambda text: text.str.len() / 4

    got = {r[0]: tuple(r)[1:] for r in score.score_with(rows, "mine", load).collect()}
    assert got == {"a": (0.5, 1, "positive", "mine"), "b": (0.25, 0, "negative", "mine")}
    with pytest.raises(PySparkException):
        score.score_with(rows, "bad", lambda: lambda t: pd.Series([2.0] * len(t))).collect()


def test_stream_scores_like_batch(spark, rung, tmp_path):
    rows = spark.createDataFrame([("x", "lovely great"), ("y", "awful poor")],
                                 "sentence_id string, text string")
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = (score_stream(stream, rung).writeStream.format("memory").queryName("scored_rows")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.table("scored_rows").collect()}
    finally:
        query.stop()
    assert got == {tuple(r) for r in score.score_batch(rows, rung).collect()}


def test_whole_run(spark, tmp_path):
    rows, vectors = [], []
    rng = np.random.default_rng(3)
    for i in range(60):
        label = i % 2
        rows.append(("abc"[i // 2 % 3], f"{_text(i, label)} tail{i}", label, i))
    rows.append(("a", rows[0][1].upper(), 0, 99))
    labelled = spark.createDataFrame(rows, "source string, text string, label bigint, line int")
    from assayline.operators.dedup import prepare

    for row in prepare(labelled, ["line"]).collect():
        vectors.append((row["sentence_id"], (rng.normal(size=4) + 2 * row["label"]).tolist()))
    given = spark.createDataFrame(vectors, "sentence_id string, embedding array<double>")
    folder = str(tmp_path / "evidence")
    result = run_benchmark(
        labelled, ["line"], folder, given, embedding=learn.EmbeddingSettings(epochs=3), resamples=50
    )
    tables_ = result.tables
    comparison = tables_["model_comparison"].collect()
    assert {r["model"] for r in comparison} == set(learn.FAMILIES)
    best = max(comparison, key=lambda r: r["validation_macro_f1"])["validation_macro_f1"]
    champion = [r for r in comparison if r["model"] == result.champion_model][0]
    assert champion["validation_macro_f1"] == best
    assert tables_["paired_deltas"].count() == 4
    manifest = tables_["run_manifest"].first()
    assert (manifest["raw_rows"], manifest["prepared_rows"]) == (61, 60)
    assert (manifest["train_rows"], manifest["validation_rows"], manifest["test_rows"]) == (36, 12, 12)
    written = set(os.listdir(folder))
    assert {"model_comparison", "test_predictions", "model_disagreements", "source_metrics",
            "paired_deltas", "dataset_by_source", "split_distribution", "run_manifest",
            "dataset_summary", f"{learn.TFIDF_NAME}_search", f"{learn.EMBEDDING_NAME}_history"} <= written
    assert tables.strict_json_rows(tables_["run_summary"]).count() == 1


def test_embedding_rung_learns_and_repeats_itself(spark):
    rng = np.random.default_rng(11)
    filler = [f"f{i}" for i in range(40)]
    rows = []
    for i in range(240):
        label = int(rng.random() < 0.6)
        words = [*rng.choice(filler, 6), ["bad", "good"][label], ["poor", "fine"][label]]
        split = ("train", "train", "train", "validation", "test")[i % 5]
        rows.append((str(i), " ".join(rng.permutation(words)), label, split))
    schema = "sentence_id string, text string, label bigint, split string"
    settings = learn.EmbeddingSettings(epochs=4, patience=2)
    rungs = [learn.embedding_rung(spark.createDataFrame(rows, schema).repartition(n), settings) for n in (2, 7)]
    history = [[tuple(r) for r in g.history.orderBy("epoch").collect()] for g in rungs]
    assert history[0] == history[1]
    test = rungs[0].score(spark.createDataFrame(rows, schema).where("split = 'test'")).collect()
    right = np.mean([(r.probability >= 0.5) == r.label for r in test])
    assert right > 0.2 + max(np.mean([r.label for r in test]), 1 - np.mean([r.label for r in test])) - 0.05


def test_embedding_rung_learns_words_in_parts_of_a_table_and_encodes_texts_once(spark, monkeypatch):
    learned, encoded = [], []

    class Words(learn.Word2Vec):
        def fit(self, rows, params=None):
            learned.append((self.getNumPartitions(), rows.rdd.getNumPartitions()))
            return super().fit(rows, params)

    encode = learn.encode_text
    monkeypatch.setattr(learn, "Word2Vec", Words)
    monkeypatch.setattr(learn, "encode_text", lambda df, *rest: encoded.append(df.columns) or encode(df, *rest))
    n = F.col("id")
    label = (F.xxhash64("id") % 2 == 0).cast("bigint")
    rows = spark.range(9_600).select(
        n.cast("string").alias("sentence_id"), label.alias("label"),
        F.concat_ws(" ", n.cast("string"), F.when(label == 1, "good fine").otherwise("bad poor")).alias("text"),
        F.when(n < 9_000, "train").when(n < 9_300, "validation").otherwise("test").alias("split"),
    )
    rung = learn.embedding_rung(rows, learn.EmbeddingSettings(epochs=1, patience=1, vocabulary_size=20))
    assert learned == [(2, 2)]  # 9,000 train rows: no core learns them alone
    assert len(encoded) == 2  # train texts and validation texts, each once
    test = rung.score(rows.where("split = 'test'"))
    assert test.where((F.col("probability") >= 0.5) == (F.col("label") == 1)).count() == 300
