"""Archives where they lie: streamed members, checks in turn, a published table or none."""

import hashlib
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from assayline.plans import data_queries
from assayline.schema import IntegrityError
from assayline.sources import archives, lines

SOURCES = {"one.txt": "a", "two.txt": "b"}
BODIES = {
    "x/one.txt": b"\xef\xbb\xbfinner\ttab\t1\r\nGreat phone\t1\nBad\t0\n",
    "y/two.txt": "ＣＬＥＡＮ text\t1\ngreat   PHONE\t1\nfilm\t0".encode(),
    "readme.txt": b"no member",
}
ROWS = {("a", "inner\ttab", 1), ("a", "Great phone", 1), ("a", "Bad", 0),
        ("b", "ＣＬＥＡＮ text", 1), ("b", "film", 0)}


def _zip(path, bodies) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("nested/", "")
        for name, body in bodies.items():
            archive.writestr(name, body)
    return str(path)


def _manifest(spark, path, bodies=None, **change):
    rows = [(path, hashlib.sha256(open(path, "rb").read()).hexdigest())]
    for name, body in (bodies or {}).items():
        base = name.rsplit("/", 1)[-1]
        if base in SOURCES:
            rows.append((f"{path}!/{base}", hashlib.sha256(body).hexdigest()))
    return spark.createDataFrame(
        [(p, change.get("digest", d) if p.endswith(change.get("end", "?")) else d) for p, d in rows],
        "path string, expected_sha256 string")


def test_archives_become_a_published_table(spark, tmp_path):
    path, target = _zip(tmp_path / "in.zip", BODIES), str(tmp_path / "table")
    manifest = _manifest(spark, path, BODIES)
    for fmt in ("parquet", "csv"):  # the second replaces the first
        found = archives.prepare_archives(spark, path, SOURCES, target, manifest, 6, 5, fmt=fmt)
        assert {tuple(r)[1:] for r in found.rows.collect()} == ROWS
        assert found.raw_rows == 6
        assert {r.path.rsplit("/", 1)[-1]: r.length for r in found.checksums.collect()} == {
            "in.zip": os.path.getsize(path), "one.txt": len(BODIES["x/one.txt"]), "two.txt": len(BODIES["y/two.txt"])}


def test_equal_texts_of_many_archives_keep_the_first(spark, tmp_path):
    for name in ("b", "a", "c"):
        bodies = {"one.txt": f"only {name}\t0\nShared\t1\n".encode(), "two.txt": f"shared \t1\n{name} two\t0\nz{name}\t1".encode()}
        _zip(tmp_path / f"{name}.zip", bodies)
    found = archives.checked_archives(spark, str(tmp_path), SOURCES, pattern="*.zip")
    kept = found.rows.where(F.lower("text") == "shared").collect()
    assert [(r.source, r.text) for r in kept] == [("a", "Shared")]
    assert found.raw_rows == 15 and found.rows.count() == 10


def test_a_source_may_repeat_earlier_ones_if_said(spark, tmp_path):
    path, target = str(tmp_path / "in.zip"), str(tmp_path / "table")
    run = lambda two, **k: archives.prepare_archives(
        spark, _zip(path, {**BODIES, "y/two.txt": two}), SOURCES, target, **k)
    repeated = b"GREAT phone\t1\nbad\t0\n"
    with pytest.raises(IntegrityError, match="source_set"):
        run(repeated)
    found = run(repeated, may_repeat=True)
    assert {tuple(r)[1:] for r in found.rows.collect()} == {row for row in ROWS if row[0] == "a"}
    assert found.raw_rows == 5
    left = run(b"great phone\t1\nfilm\t0", may_repeat=True).rows  # one label of b is left
    assert [tuple(r)[1:] for r in left.where("source = 'b'").collect()] == [("b", "film", 0)]
    for two, message in ((b"", "no line of b"), (b"film\t0", "lines of b have one label"),
                         (b"great phone\t0\nfilm\t1", "conflicting")):
        with pytest.raises(IntegrityError, match=message):
            run(two, may_repeat=True)
    assert spark.read.parquet(target).count() == 4


def test_the_query_takes_copies_with_keys_shifted_by_an_odd_number(spark, tmp_path):
    texts = [(i, f"text  {i}", "en", i % 3 % 2) for i in range(40)]
    rows = [(i + shift, *rest) for shift in (0, 1001) for i, *rest in texts]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    made.select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    made.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    found = data_queries.prepare_archives(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:] for r in found) == sorted(("even", text, q) for _, text, _, q in texts)


def test_the_query_takes_equal_texts_with_several_labels(spark, tmp_path):
    """As in a table of copies whose labels are shifted by another number than their documents; the first text stands."""
    texts = [(i, f"text  {i}", "en") for i in range(40)]
    made = spark.createDataFrame([(i + s, *rest) for s in (0, 40) for i, *rest in texts], "doc_id bigint, text string, lang string")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i + s, i % 3 % 2) for s in (0, 41) for i in range(39)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = data_queries.prepare_archives(spark, str(tmp_path)).collect()
    # even lines come before odd ones; each text has its own label, or none, or that of the copy before it
    given = [(d, f"text  {d % 40}", q) for d, q in labels]
    first = {}
    for doc, text, label in sorted(given, key=lambda g: (g[0] % 2, g[0])):
        first.setdefault(text, (["even", "odd"][doc % 2], text, label))
    assert sorted(tuple(r)[1:] for r in found) == sorted(first.values())
    assert len({(t, q) for _, t, q in given}) > len(first)


def test_conflicts_are_reported_where_they_are_allowed(spark, tmp_path):
    path = _zip(tmp_path / "in.zip", {**BODIES, "y/two.txt": b"great phone\t0\nfilm\t1\nplot\t0"})
    with pytest.raises(IntegrityError, match="conflicting"):
        archives.checked_archives(spark, path, SOURCES)
    found = archives.checked_archives(spark, path, SOURCES, may_conflict=True)
    assert ("a", "Great phone", 1) in {tuple(r)[1:] for r in found.rows.collect()} and found.rows.count() == 5
    assert [tuple(r)[1:] for r in found.conflicts.collect()] == [(2, 0, 1)]


def _broken_crc(path):
    """Stored bytes are changed, so the member's CRC is wrong and the directory is whole."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        for name, body in BODIES.items():
            archive.writestr(name, body)
    data = open(path, "rb").read().replace(b"film", b"folm")
    open(path, "wb").write(data)


@pytest.mark.parametrize("change,message", [
    (lambda b: {**b, "z/two.txt": b"more\t1"}, "two.txt.*found 2"),
    (lambda b: {k: v for k, v in b.items() if "two" not in k}, "two.txt.*found 0"),
    (lambda b: {**b, "y/two.txt": b"great phone\t0\nfilm\t1"}, "conflicting"),
    (lambda b: {**b, "y/two.txt": b"film\t0\n\nmore\t1"}, "line 2: empty line"),
    (lambda b: {**b, "y/two.txt": b"bad\xff\t0\nmore\t1"}, "line 1: invalid utf-8"),
    (lambda b: {**b, "y/two.txt": b"film\t0"}, "source_has_both_labels|both"),
    (lambda b: {**b, "y/two.txt": b""}, "source"),
    (lambda b: {}, "no archive"),
])
def test_a_failed_check_publishes_nothing(spark, tmp_path, change, message):
    path, target = _zip(tmp_path / "in.zip", change(BODIES)), str(tmp_path / "table")
    archives.prepare_archives(spark, _zip(tmp_path / "good.zip", BODIES), SOURCES, target)
    with pytest.raises(IntegrityError, match=message):
        archives.prepare_archives(spark, path, SOURCES, target)
    assert {tuple(r)[1:] for r in spark.read.parquet(target).collect()} == ROWS
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["good.zip", "in.zip", "table"]


def test_checksums_counts_and_broken_bytes(spark, tmp_path):
    path, target = _zip(tmp_path / "in.zip", BODIES), str(tmp_path / "table")
    run = lambda *a: archives.prepare_archives(spark, path, SOURCES, target, *a)
    for end in ("in.zip", "!/two.txt"):
        with pytest.raises(IntegrityError, match=f"{end}.*mismatch"):
            run(_manifest(spark, path, BODIES, end=end, digest="0" * 64))
    with pytest.raises(ValueError, match="64"):
        run(_manifest(spark, path, BODIES, end="in.zip", digest="short"))
    with pytest.raises(IntegrityError, match="one.txt is not in the manifest|two.txt is not in the manifest"):
        run(_manifest(spark, path, BODIES).limit(0))
    run(_manifest(spark, path))  # the archive's entry stands for its members
    for counts in ((None, 7, None), (None, None, 4)):
        with pytest.raises(IntegrityError, match="unexpected"):
            run(*counts)
    _broken_crc(path)
    with pytest.raises(IntegrityError, match="two.txt.*CRC"):
        run()
    open(path, "wb").write(b"no zip at all")
    with pytest.raises(IntegrityError, match="in.zip"):
        run()


def test_long_members_are_read_in_pieces(spark, tmp_path):
    """Lines across pieces, one line longer than several pieces, a lone carriage return at the end."""
    rng = random.Random(5)
    values = ["".join(rng.choices("abc \r\x0b", k=rng.randrange(200))) for _ in range(30_000)]
    values[777] = "w" * 3_500_000
    body = "\n".join(values + ["\r"]).encode()
    path = _zip(tmp_path / "in.zip", {"one.txt": body, "two.txt": b"\r"})
    entries = archives.archive_entries(spark, path)
    members = archives.read_members(entries)
    found = members.lines.orderBy("line_number").collect()
    assert [(r.line_number, r.value) for r in found] == list(enumerate(values, 1))
    facts = {r.basename: (r.sha256, r.length, r.error) for r in members.facts.collect()}
    assert facts == {"one.txt": (hashlib.sha256(body).hexdigest(), len(body), None),
                     "two.txt": (hashlib.sha256(b"\r").hexdigest(), 1, None)}
    # the same numbering as a scan of the unpacked file
    (tmp_path / "one.txt").write_bytes(body)
    scan = lines.scan_lines(spark, str(tmp_path / "one.txt")).select("line_number", "value")
    assert scan.exceptAll(members.lines.select("line_number", "value")).count() == 0
