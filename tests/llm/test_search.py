"""Decontamination, packing, nearest neighbours and chat formatting."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayline.llm import chat, decontaminate, kmeans_tree, packing

LETTERS = "abcdefgh"


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=90), st.binary(max_size=120), st.booleans())
def test_myers_distance(pattern, text, few):
    if few:
        pattern, text = (bytes(b"ab"[c & 1] for c in x) for x in (pattern, text))
    assert decontaminate.myers_best(pattern, text)[0] == brute_distance(pattern, text)


def spoiled(text, edits, draw):
    text = list(text)
    for _ in range(edits):
        at = draw.randrange(len(text))
        kind = draw.randrange(3)
        text[at : at + 1] = [[], [draw.choice(LETTERS)], [text[at], draw.choice(LETTERS)]][kind]
    return "".join(text)


def test_leaks_are_those_of_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    items = [(n, "".join(draw.choice(LETTERS) for _ in range(draw.randint(32, 90)))) for n in range(12)]
    items += [(12, items[0][1]), (13, None), (14, "tiny"), (15, ""), (None, "x" * 50)]
    docs = []
    for number in range(120):
        filler = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for _ in range(2)]
        item = draw.choice(items[:13])[1]
        body = spoiled(item, draw.randint(0, 9), draw) if number % 2 else ""
        if number % 6 == 1:
            body = " ".join(body[i : i + 7].upper() for i in range(0, len(body), 7)) + "!"
        docs.append((number, filler[0] + body + filler[1]))
    docs += [(200, None), (201, ""), (3, docs[3][1]), (None, items[1][1]), (202, "q" * 50_000 + items[2][1])]
    expected = []
    for number, text in docs:
        body = decontaminate.normalise(text or "")
        for item, pattern in items[:13]:
            least = brute_distance(pattern.encode(), body[-400:])
            if least <= decontaminate.error_budget(len(pattern)):
                expected.append((number, item, least))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)  # several blocks
    found = [(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(rows, bench).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    clean = decontaminate.without_leaks(rows, bench)
    assert clean.columns == rows.columns
    gone = {r[0] for r in expected}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((n for n, _ in docs if n not in gone), key=repr)
    assert decontaminate.find_leaks(rows, bench.where("false")).count() == 0
    assert decontaminate.without_leaks(rows.where("false"), bench).count() == 0


def counts(lengths, size=1024):
    return np.bincount(np.array(lengths, int), minlength=size + 1)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_a_plan_holds_exactly_the_histogram(lengths):
    plan = packing.plan(counts(lengths, 64), 64)
    assert all(sum(group) <= 64 and copies > 0 for group, copies in plan)
    back = [v for group, copies in plan for v in group * copies]
    assert sorted(back) == sorted(lengths)


def test_plans_are_near_the_bound():
    draw = np.random.default_rng(1)
    for lengths in (draw.integers(1, 1025, 100_000), np.clip(np.exp(draw.normal(6, 1, 60_000)).astype(int), 1, 1024)):
        plan = packing.plan(counts(lengths))
        assert sum(copies for _, copies in plan) <= 1.005 * -(-lengths.sum() // 1024)
    assert packing.plan(counts([])) == []


def test_patterns_make_the_plan_where_best_fit_would_do_as_well():
    lengths = [424, 600] * 100
    assert sum(copies for _, copies in packing.best_fit(counts(lengths), 1024)) == 100
    assert packing.plan(counts(lengths)) == [((424, 600), 100)]  # a pattern's lengths ascend


def test_items_of_one_id_are_one_item_in_any_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    texts = {n: " ".join(f"{n}word{i}" for i in range(12)) for n in range(6)}
    bench = [(n % 2, t) for n, t in texts.items()] + [(9, "too short"), (None, texts[0]), (10, None)]
    bench = spark.createDataFrame(bench, "item_id bigint, text string").repartition(4)
    docs = spark.createDataFrame([(1, " ".join(texts.values())), (2, texts[3])], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == [(1, 0), (1, 1), (2, 1)]
    left = {(r.item_id, r.n_bytes) for r in decontaminate.unmatched_items(bench).collect()}
    assert left == {(9, 8), (10, 0), (None, len(decontaminate.normalise(texts[0])))}


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(spark):
    draw = random.Random(2)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "word " * 700), (4, "word <|endoftext|> x"), (5, "é😀 " * 3000)]
    rows += [(n, " ".join(draw.choice(["the", "thing", "ouen", "x1"]) for _ in range(draw.randint(1, 900)))) for n in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("length", F.lit("x")).repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for number, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        bounds = [0, *range(head, len(ids) + 1, 1024)] if head else [*range(0, len(ids) + 1, 1024)]
        for piece, (low, high) in enumerate(zip(bounds, bounds[1:])):
            crc = zlib.crc32(np.array(ids[low:high], "<u4").tobytes())
            expected.append((number, piece, low, high - low, crc))
    found = packing.pack_documents(docs, PATH).collect()
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(expected, key=repr)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= 1024
        assert all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:]))
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0


def brute_nearest(rows, query, k):
    number, vector = query
    scored = sorted((-float(np.dot(np.array(v, float), np.array(vector, float))), n) for n, v in rows if n != number)
    return scored[:k]


def test_neighbours_with_ties_copies_and_bad_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(int(n), [float(np.float32(x)) for x in draw.normal(size=6)]) for n in range(100)]
    rows += [(n, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for n in range(100, 260)]  # a large group of copies
    bad = [(300, None), (301, [0.0] * 6), (320, [float("nan")] + [1.0] * 5), (340, [float("inf")] + [1.0] * 5),
           (360, [None] + [1.0] * 5), (380, [1.0] * 5), (None, [1.0] * 6), (400, [])]
    table = spark.createDataFrame(rows + bad + rows[:5], "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    found = defaultdict(list)
    for r in kmeans_tree.nearest(table.repartition(4), F.col("id") % 20 == 0, 20).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(found) == [n for n, _ in rows if n % 20 == 0]
    for number, places in found.items():
        places.sort()
        expected = brute_nearest(rows, (number, dict(rows)[number]), 20)
        assert [p[0] for p in places] == list(range(1, 21))
        assert [p[1] for p in places] == [n for _, n in expected]
        assert [p[2] for p in places] == pytest.approx([-s for s, _ in expected])
    assert kmeans_tree.nearest(table.where("false"), F.col("id") % 20 == 0, 20).count() == 0
    few = {(r.query_id, r.vec_id) for r in kmeans_tree.nearest(table.where("vec_id < 4"), F.col("id") == 0, 20).collect()}
    assert few == {(0, 1), (0, 2), (0, 3)}


def test_neighbours_through_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 40)
    monkeypatch.setattr(kmeans_tree, "PART", 64)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    rows = [(n, (centres[n % 12] + 0.4 * draw.normal(size=16)).tolist()) for n in range(3000)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    vectors = kmeans_tree.valid_vectors(table, "vec_id", "embedding")
    index, tree, sizes = kmeans_tree.build_index(vectors, 10)
    visits = kmeans_tree.calibrate(index, vectors.where("id % 20 = 0"), tree, sizes, 10)
    assert tree.leaves > 20 and sizes.sum() == 3000 and visits < tree.leaves
    found = defaultdict(set)
    for r in kmeans_tree.nearest(table, F.col("id") % 20 == 0, 10).collect():
        found[r.query_id].add(r.vec_id)
    recall = [len(found[q[0]] & {n for _, n in brute_nearest(rows, q, 10)}) / 10 for q in rows if q[0] % 20 == 0]
    assert np.mean(recall) >= 0.9


PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[TURN]", "[AS]", "[/TURN]", "\\", "[", "<", "s>", "INST]", "\n", "é", "x"]
ROLES = ["system", "user", "assistant", "tool", "", "[AS]", "us\ner"]


def test_chat_round_trip(spark):
    draw = random.Random(6)
    conversations = {}
    for number in range(300):
        conversations[number] = [
            (draw.choice(ROLES),
             "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 8)))) for _ in range(draw.randint(1, 6))
        ]
    rows = [(c, t, role, text, "x") for c, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments string")
    output = chat.format_conversations(frame.repartition(4))
    read = output.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("segments")).alias("loss")
    ).collect()
    assert len(read) == len(conversations)
    for r in read:
        turns = conversations[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(text for role, text in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        error, state = None, ""
        for at, (role, _) in enumerate(turns):
            if error is None and role not in chat.DEFAULT.follows.get(state, ()):
                error = at
            state = role
        if error is None and state not in chat.DEFAULT.ends:
            error = len(turns)
        assert (r.valid, r.first_error) == (error is None, error)


def test_chat_of_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, "user", None), (1, 1, None, "b"), (2, 0, "user", "q"), (2, 0, "user", "q"),
            (3, 0, "assistant", "y" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat.format_conversations(frame).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [("user", ""), ("", "b")]
    assert len(found[2].turns) == 2 and not found[2].valid
    assert len(found[3].turns[0].text) == 200_000
    assert found[None].first_error == 1
    assert chat.format_conversations(frame.where("false")).count() == 0


def test_chat_stays_native_and_templates_are_checked(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.format_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    with pytest.raises(ValueError, match="could be read"):
        chat.Template({"user": chat.Marks("[ab", "b]c")}, {"": ("user",)}, ("user",))
