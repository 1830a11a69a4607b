"""Splits: exact sizes, order independence, leakage, broken assignments."""

import pytest
from pyspark.sql import functions as F

from assayline.operators import quality, split
from assayline.operators.split import SplitConfig
from assayline.schema import IntegrityError, SplitError
from assayline.sources import tables

# Published strata of the official corpus: (source, label) -> rows.
OFFICIAL = {("amazon", 0): 496, ("amazon", 1): 491, ("imdb", 0): 498, ("imdb", 1): 498,
            ("yelp", 0): 497, ("yelp", 1): 499}


def _frame(spark, strata):
    rows = [(f"{s}-{y}-{i}", s, f"text {s} {y} {i}", y) for (s, y), n in strata.items() for i in range(n)]
    return spark.createDataFrame(rows, "sentence_id string, source string, text string, label bigint")


@pytest.fixture(scope="module")
def balanced(spark):
    return _frame(spark, {(s, y): 10 for s in ("a", "b", "c") for y in (0, 1)}).cache()


def _sizes(frame, *by):
    return {tuple(r)[:-1]: r["count"] for r in frame.groupBy(*by).count().collect()}


def test_balanced_split(balanced):
    assigned = split.create_splits(balanced)
    assert _sizes(assigned, "split") == {("train",): 36, ("validation",): 12, ("test",): 12}
    by_stratum = _sizes(assigned, "source", "label", "split")
    assert set(by_stratum.values()) == {6, 2} and len(by_stratum) == 18


@pytest.mark.parametrize("digits", [1, 4])
def test_official_sizes_and_row_order(spark, digits):
    frame = _frame(spark, OFFICIAL)
    first = {tuple(r) for r in split.stratified_split(frame, hash_digits=digits).collect()}
    again = {tuple(r) for r in split.stratified_split(
        frame.orderBy(F.rand(3)).repartition(7), hash_digits=digits).collect()}
    assert first == again
    names = [s for _, s in first]
    assert [names.count(n) for n in ("train", "validation", "test")] == [1787, 596, 596]


def test_bucket_width_does_not_change_membership(spark):
    frame = _frame(spark, OFFICIAL)
    wide, narrow = (
        {tuple(r) for r in split.stratified_split(frame, hash_digits=d).collect()} for d in (1, 5))
    assert wide == narrow


def test_seed_changes_membership(balanced):
    one = {tuple(r) for r in split.stratified_split(balanced).collect()}
    two = {tuple(r) for r in split.stratified_split(balanced, SplitConfig(seed=7)).collect()}
    assert one != two and len(one) == len(two) == 60


def test_saved_assignments_rebuild_the_split(spark, balanced, tmp_path):
    assignments = split.stratified_split(balanced)
    expected = {tuple(r) for r in assignments.collect()}
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        tables.write_assignments(assignments, path, fmt)
        assert {tuple(r) for r in tables.read_assignments(spark, path, fmt).collect()} == expected


def test_leakage_by_text_and_by_id(spark, balanced):
    assigned = split.create_splits(balanced).cache()
    split.require_no_leakage(assigned)
    row = assigned.where("split = 'train'").first()
    swapped = spark.createDataFrame([("new", row["source"], row["text"].upper(), row["label"], "test")],
                                    assigned.schema)
    with pytest.raises(SplitError, match="text"):
        split.require_no_leakage(assigned.union(swapped))
    same_id = spark.createDataFrame([(row["sentence_id"], "a", "other words", 0, "validation")],
                                    assigned.schema)
    with pytest.raises(SplitError, match="id"):
        split.require_no_leakage(assigned.union(same_id))


@pytest.mark.parametrize("change,rule", [
    (lambda a: a.where("split <> 'test'"), "split_set"),
    (lambda a: a.union(a.limit(1)), "id_unique"),
    (lambda a: a.where("sentence_id <> 'a-0-1'"), "ids_missing"),
    (lambda a: a.withColumn("sentence_id", F.concat("sentence_id", F.lit("x"))), "ids_extra"),
    (lambda a: a.withColumn("more", F.lit(1)), "columns"),
    (lambda a: a.limit(0), "non_empty"),
    (lambda a: a.withColumn("split", F.when(F.col("sentence_id") != "a-0-1", F.col("split"))), "no_nulls"),
])
def test_broken_assignments(balanced, change, rule):
    assignments = split.stratified_split(balanced)
    checked = quality.validate_assignments(change(assignments), balanced).collect()
    assert rule in {r["rule"] for r in checked if r["violations"]}


def test_join_needs_unique_ids(balanced):
    assignments = split.stratified_split(balanced)
    with pytest.raises(SplitError):
        split.apply_split(balanced, assignments.union(assignments.limit(1)))


def test_tiny_stratum_and_bad_proportions(spark):
    frame = _frame(spark, {("a", 0): 10, ("a", 1): 2})
    with pytest.raises(SplitError, match="three"):
        split.create_splits(frame)
    for test, validation in ((0.0, 0.2), (0.6, 0.5), (float("nan"), 0.2), (-0.1, 0.2)):
        with pytest.raises(SplitError, match="share"):
            split.stratified_split(frame, SplitConfig(test_size=test, validation_size=validation))


def test_rows_with_a_null_source_or_label_are_assigned_too(spark):
    rows = [(str(i), None if i % 3 == 0 else "a", None if i % 5 == 0 else i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "sentence_id string, source string, label bigint")
    found = {r.sentence_id: r.split for r in split.stratified_split(frame).collect()}
    assert sorted(found) == sorted(r[0] for r in rows)
    assert sorted(found.values()).count("test") == 12 and None not in found.values()


def test_split_rules_for_training(spark):
    schema = "sentence_id string, text string, label bigint, split string"
    good = [("1", "x", 0, "train"), ("2", "y", 1, "train"), ("3", "z", 1, "validation"),
            ("4", "q", None, "test")]
    quality.require_splits(quality.validate_splits(spark.createDataFrame(good, schema)))
    for bad in (good[:3], good[1:], [("1", " ", 0, "train"), *good[1:]],
                [*good[:2], ("3", "z", None, "validation"), good[3]],
                [*good[:2], ("3", "z", 2, "validation"), good[3]]):
        with pytest.raises(ValueError):
            quality.require_splits(quality.validate_splits(spark.createDataFrame(bad, schema)))
    strict = quality.validate_splits(spark.createDataFrame(good, schema), require_test_labels=True)
    with pytest.raises(ValueError, match="test"):
        quality.require_splits(strict)


def test_contract_error_type(balanced):
    with pytest.raises(IntegrityError):
        split.create_splits(balanced.withColumn("text", F.lit("same")))
