"""The run from stored archives: killed, taken up again, started anew when something differs."""

import os
import re
import subprocess
import sys
import zipfile

import numpy as np
import pytest

from assayline.operators import learn
from assayline.plans import learning_queries, run
from assayline.plans.stages import Stages
from assayline.schema import IntegrityError
from assayline.session import fresh_path, folder_exists, scratch, shared_folder

SOURCES = {"one.txt": "a", "two.txt": "b"}
KILLED = """
import os, sys
from assayline.operators import learn
from assayline.plans import learning_queries, run
from assayline.session import local_session
run.embedding_rung = lambda *_: os._exit(9)
run.run_archives(local_session("4", "killed"), sys.argv[1], {"one.txt": "a", "two.txt": "b"}, sys.argv[2],
    settings=run.RunSettings(embedding=learn.EmbeddingSettings(epochs=2), resamples=20))
"""


def _settings(**change):
    return run.RunSettings(**{"embedding": learn.EmbeddingSettings(epochs=2), "resamples": 20, **change})


def _intermediates(spark) -> set[str]:
    """What the library wrote to the shared folder; each Spark context makes a folder of its own there."""
    return {n for n in os.listdir(shared_folder(spark)) if re.search("-[0-9a-f]{32}$", n)}


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    rng = np.random.default_rng(8)
    path = tmp_path_factory.mktemp("archives") / "in.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for member in SOURCES:
            body = ""
            for i in range(60):
                words = " ".join(rng.choice([f"w{k}" for k in range(30)], 6))
                body += f"{words} {['poor', 'fine'][i % 2]} {member[:3]}{i}\t{i % 2}\n"
            archive.writestr(member, body)
    return str(path)


def test_a_killed_run_goes_on_from_its_last_whole_stage(spark, stored, tmp_path, monkeypatch):
    folder = str(tmp_path / "evidence")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    before = _intermediates(spark)
    killed = subprocess.run([sys.executable, "-c", KILLED, stored, folder], cwd=root, timeout=300, capture_output=True)
    assert killed.returncode == 9
    left = [n for n in os.listdir(folder) if n.startswith("stages-")]
    assert len(left) == 1 and not os.path.exists(f"{folder}/model_comparison")
    done = {n for n in os.listdir(f"{folder}/{left[0]}") if not n.startswith(".")}
    assert {"prepared", "checksums", "assigned", f"{learn.TFIDF_NAME}-costs"} <= done
    assert f"{learn.EMBEDDING_NAME}-costs" not in done

    def twice(*_, **__):
        raise AssertionError("this stage was whole")

    with monkeypatch.context() as patched:
        for name in ("candidate_search", "checked_archives"):
            patched.setattr(run, name, twice)
        resumed = run.run_archives(spark, stored, SOURCES, folder, settings=_settings())
    whole = run.run_archives(spark, stored, SOURCES, str(tmp_path / "other"), settings=_settings())
    kept = ["model", "test_accuracy", "test_macro_f1", "validation_macro_f1", "test_roc_auc"]
    rows = [[tuple(r) for r in e.tables["model_comparison"].select(kept).orderBy("model").collect()] for e in (resumed, whole)]
    assert len(rows[0]) == 2 and rows[0] == rows[1]
    assert resumed.champion_model == whole.champion_model
    manifest = resumed.tables["run_manifest"].first()
    assert (manifest["raw_rows"], manifest["prepared_rows"]) == (120, 120)
    assert manifest["config"]["input_digest"] == whole.tables["run_manifest"].first()["config"]["input_digest"]
    assert {r.path.rsplit("/", 1)[1] for r in resumed.tables["input_checksums"].collect()} == {"in.zip", *SOURCES}
    assert all(rows.limit(1).count() == 1 for name, rows in resumed.tables.items() if name != "model_disagreements")
    # nothing of the way is left, of the killed run neither: no stage, no intermediate
    assert not [n for n in os.listdir(folder) if n.startswith(("stages-", ".stages"))]
    assert _intermediates(spark) == before


def test_another_setting_or_manifest_starts_anew(spark, stored, tmp_path, monkeypatch):
    folder = str(tmp_path / "evidence")

    def stop(*_, **__):
        raise RuntimeError("stopped")

    monkeypatch.setattr(run, "candidate_search", stop)
    wrong = spark.createDataFrame([(stored, "0" * 64)], "path string, expected_sha256 string")
    with pytest.raises(IntegrityError, match="mismatch"):
        run.run_archives(spark, stored, SOURCES, folder, wrong, settings=_settings())
    assert not [n for _, below, _ in os.walk(folder) for n in below if not n.startswith("stages-")]
    for settings in (_settings(), _settings(), _settings(seed=7)):
        with pytest.raises(RuntimeError, match="stopped"):
            run.run_archives(spark, stored, SOURCES, folder, settings=settings)
    # the first two share their stages; the manifest is checked though prepared rows are there
    assert len([n for n in os.listdir(folder) if os.path.exists(f"{folder}/{n}/prepared")]) == 2
    with pytest.raises(IntegrityError, match="mismatch"):
        run.run_archives(spark, stored, SOURCES, folder, wrong, settings=_settings())


def test_stages_are_computed_once_and_dropped_alone(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    build = lambda: spark.range(5)
    assert [stages.table("x", build).count() for _ in range(2)] == [5, 5] and stages.computed == ["x"]

    def broken():
        return spark.range(3).selectExpr("raise_error('no') as id")

    with pytest.raises(Exception, match="no"):
        stages.table("y", broken)
    assert not stages.has("y") and stages.has("x")
    again = Stages(spark, str(tmp_path / "s"))
    again.table("x", broken)
    again.drop("x")
    assert not again.has("x")
    again.clear()
    assert not folder_exists(spark, again.folder)


def test_scratch_is_deleted_after_errors_too(spark):
    outside = fresh_path(spark, "t")
    with pytest.raises(RuntimeError), scratch(spark) as folder:
        spark.range(3).write.parquet(fresh_path(spark, "t"))
        assert len(os.listdir(folder)) == 1
        raise RuntimeError
    assert not os.path.exists(folder) and os.path.dirname(fresh_path(spark, "t")) == os.path.dirname(outside)


def test_a_run_lists_the_texts_with_several_labels_where_they_are_allowed(spark, monkeypatch):
    rows = [("1", "a", "Fine", 1, 1), ("2", "a", "fine", 0, 2), ("3", "b", "poor", 0, 3)]
    labelled = spark.createDataFrame(rows, "sentence_id string, source string, text string, label bigint, place int")
    monkeypatch.setattr(run, "run_prepared", lambda stages, prepared, raw_rows, *_, conflicts=None: (prepared, raw_rows, conflicts))
    with pytest.raises(IntegrityError, match="conflicting"):
        run.run_benchmark(labelled, ["place"])
    prepared, raw_rows, conflicts = run.run_benchmark(labelled, ["place"], may_conflict=True)
    assert sorted(tuple(r)[1:] for r in prepared.collect()) == [("a", "Fine", 1), ("b", "poor", 0)] and raw_rows == 3
    assert [tuple(r)[1:] for r in conflicts.collect()] == [(2, 0, 1)]


def test_every_sentence_of_the_query_has_one_vector_whatever_their_ids(spark, tmp_path, monkeypatch):
    """Ids with gaps, repeated ids and a null one, as in a table of copies with shifted keys."""
    docs = [(i, f"text {i}", "ab"[i % 2]) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = [0, 1, 1, 2, 1_000, 1_001, None]
    given = [(v, [-1.0 if v is None else float(v)]) for v in ids]
    spark.createDataFrame(given, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []

    def stop(labelled, order, vectors, **_):
        seen.extend(vectors.collect())
        raise InterruptedError

    monkeypatch.setattr(learning_queries, "run", stop)
    with pytest.raises(InterruptedError):
        learning_queries.run_benchmark(spark, str(tmp_path))
    assert len(seen) == len({r["sentence_id"] for r in seen}) == 40
    assert {r["embedding"][0] for r in seen} == {0.0, 1.0, 2.0, 1_000.0, 1_001.0}
