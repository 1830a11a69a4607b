"""The hash tree against draws made one by one, and its law under growth."""

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from assayline.llm import hash_tree, queries
from assayline.llm.hash_tree import Leaf, assign, uniform, with_slots


def hash_long(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)


def shard_by_hand(key, leaves):
    paths = {leaf: hash_tree._paths(leaf) for leaf in leaves}
    held = list(leaves)
    for level in range(3):
        weights = Counter()
        for leaf in held:
            weights[paths[leaf][level]] += leaf.weight

        def draw(path):
            seed = 42 if key is None else hash_long(key, 42)
            bits = xxhash.xxh64_intdigest(path.encode(), seed) >> 11
            return -math.log((bits + 0.5) * 2.0**-53) / weights[path]

        best = min(weights, key=draw)
        held = [leaf for leaf in held if paths[leaf][level] == best]
    return held[0].shard


def test_query(spark, folder):
    found = queries.op12_sharding(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == shard_by_hand(r.doc_id, uniform(8))
        assert r.grown_shard == shard_by_hand(r.doc_id, uniform(9)) and r.grown_shard in (r.shard, 8)
    for shard in range(8):
        held = sorted((r.slot, r.doc_id) for r in found if r.shard == shard)
        assert [s for s, _ in held] == list(range(len(held))) and len(held) > len(found) / 16
        assert [d for _, d in held] == sorted(d for _, d in held)


@pytest.mark.parametrize("count", [1, 2, 6, 8, 9, 13])
def test_one_more_shard_takes_rows_only_into_itself(spark, count):
    rows = assign(assign(spark.range(4000), uniform(count), ["id"], "a"), uniform(count + 1), ["id"], "b")
    moved = [(r.a, r.b) for r in rows.collect() if r.a != r.b]
    assert moved and {b for _, b in moved} == {count}
    assert abs(len(moved) / 4000 - 1 / (count + 1)) < 0.04


def test_weights_move_rows_only_where_they_change(spark):
    base = uniform(8)
    heavier = [*base, Leaf(3, 0, 1, 2.0, generation=1)]  # more weight for an old shard
    lighter = [leaf if leaf.shard != 6 else Leaf(6, leaf.region, leaf.rack, 0.25) for leaf in base]
    rows = spark.range(8000)
    for other, gained, lost in ((heavier, {3}, set(range(8)) - {3}), (lighter, set(range(8)) - {6}, {4, 5, 6, 7})):
        both = assign(assign(rows, base, ["id"], "a"), other, ["id"], "b").where("a <> b").collect()
        assert {r.b for r in both} <= gained and {r.a for r in both} <= lost
    # inside the region that kept its weights, nothing moved
    kept = assign(assign(rows, base, ["id"], "a"), lighter, ["id"], "b").where("a in (0, 1, 2, 3)")
    assert kept.where("a <> b").count() == 0
    share = assign(rows, lighter, ["id"], "b").groupBy("b").count().collect()
    assert abs({r.b: r["count"] for r in share}[6] / 8000 - 0.25 / 7.25) < 0.015


def test_bad_topologies():
    with pytest.raises(ValueError):
        uniform(0)
    with pytest.raises(ValueError):
        Leaf(0, 0, 0, 0.0)
    with pytest.raises(ValueError):
        hash_tree._levels([Leaf(0, 0, 0), Leaf(0, 0, 0)])


def test_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a")] * 3 + [(7, None)] * 500 + [(8, "")], "doc_id bigint, __at string")
    named = rows.withColumnRenamed("__at", "text").withColumn("shard_", F.lit("x"))
    placed = with_slots(assign(named, uniform(8), ["doc_id"]), "shard", ["doc_id"]).collect()
    assert len(placed) == 504 and {r.shard_ for r in placed} == {"x"}
    for shard in {r.shard for r in placed}:
        held = [r for r in placed if r.shard == shard]
        assert sorted(r.slot for r in held) == list(range(len(held)))
    assert len({r.shard for r in placed if r.doc_id == 7}) == 1
    assert with_slots(assign(named.limit(0), uniform(8), ["doc_id"]), "shard", ["doc_id"]).count() == 0


def test_written_shards_hold_their_rows(spark, tmp_path):
    docs = spark.range(200).withColumn("text", F.concat(F.lit("t"), "id"))
    hash_tree.write_shards(docs, uniform(8), ["id"], f"{tmp_path}/out")
    read = spark.read.parquet(f"{tmp_path}/out")
    assert {r.id: r.shard for r in read.collect()} == {i: shard_by_hand(i, uniform(8)) for i in range(200)}


def test_no_python_on_the_main_path(spark):
    rows = assign(spark.range(10), uniform(9), ["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
