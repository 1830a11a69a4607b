"""Line, substring and SimHash deduplication against brute force, on rows of every odd kind."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from assayline.llm import components, line_dedup, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, digest int, kept string"


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_rows():
    draw = random.Random(3)
    vocabulary = ["the", "of", "A", "b\u00e9", "Word", "x" * 40] + [f"w{i}" for i in range(30)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, passage), (4, passage), (4, passage), (4, "another " + passage)]
    for number in range(10, 60):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(1, 80))]
        text = " ".join(words) + draw.choice(["\n", " ", "\n\n"])
        rows.append((number, text + (passage.upper() if number % 3 == 0 else passage if number % 3 == 1 else "")))
    rows.append((70, "long " * 20_000 + passage))
    rows.append((71, "\n".join(f"line number {i % 700:06d}" for i in range(3000))))
    rows.append((72, "\n".join(f"line number {i:06d}" for i in range(0, 900, 7))))
    return rows


def order(doc):
    number, text = doc
    return (number is None, number or 0)


def test_lines(spark, odd_rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(lower)

    holders = {}
    for number, text in odd_rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add((number is None, number or 0))
    expected = []
    for number, text in odd_rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if key(line) not in holders or min(holders[key(line)]) == (number is None, number or 0)
        ]
        expected.append((number, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.dedup_lines(frame(spark, odd_rows))
    assert {"doc_id", "n_lines", "n_dropped", "kept"} <= set(found.columns)
    rows = [tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_lines_stay_native_and_no_key_is_one_group(spark, odd_rows):
    plan = line_dedup.dedup_lines(frame(spark, odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert "rangepartitioning" in plan


@pytest.mark.parametrize("cells", [1 << 21, 1 << 20])
def test_substrings(spark, odd_rows, cells):
    documents = sorted({((n is None, n or 0), t or "") for n, t in odd_rows}, key=lambda d: d[0])
    digests = {
        (r.none, r.number, r.text): r.digest
        for r in spark.createDataFrame([(a, b, t) for (a, b), t in documents], "none boolean, number bigint, text string")
        .withColumn("digest", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).bitwiseAND(0x7FFFFFFF))
        .collect()
    }
    documents.sort(key=lambda d: (*d[0], digests[(*d[0], d[1])]))
    seen, expected = set(), {}
    for number, text in documents:
        words = text.encode().split()
        gone = [False] * len(words)
        for start in range(len(words) - 19):
            window = tuple(words[start : start + 20])
            if window in seen:
                gone[start : start + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        expected[number, text] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    found = substring_dedup.remove_repeats(frame(spark, odd_rows), cells=cells).collect()
    rows = sorted(
        ((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found
    )
    assert rows == sorted(((n is None, n or 0), *expected[(n is None, n or 0), t or ""]) for n, t in odd_rows)


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed=42) for i in range(max(1, len(words) - width + 1))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("width", "distance"), [(3, 2), (5, 7), (1, 1), (2, 0)])
def test_simhash(spark, odd_rows, width, distance):
    prints = [(n, brute_fingerprint(t, width)) for n, t in odd_rows]
    of = brute_components({p for _, p in prints}, distance)
    least = {}
    for number, fp in prints:
        if number is not None:
            least[of[fp]] = min(number, least.get(of[fp], number))
    expected = sorted(((n, f"{p:016x}", least.get(of[p])) for n, p in prints), key=repr)
    found = simhash.near_duplicates(frame(spark, odd_rows), width, distance)
    rows = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect()]
    assert sorted(rows, key=repr) == expected


def test_links_of_a_dense_group(spark):
    draw = random.Random(9)
    base = draw.getrandbits(64)
    values = {base}
    for _ in range(400):
        values.add(draw.choice(sorted(values)) ^ 1 << draw.randrange(64))
    values |= {draw.getrandbits(64) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    rows = spark.createDataFrame(signed, "fp bigint")
    edges = simhash.links(rows, 2)
    assert edges.count() <= 64 * len(values)
    found = {r.node: r.component for r in components.component_of(edges).collect()}
    groups = {}
    for value, in signed:
        groups.setdefault(found.get(value, value), set()).add(value & (1 << 64) - 1)
    expected = {}
    for value, root in brute_components(values, 2).items():
        expected.setdefault(root, set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keep_one_in_two_lanes(spark):
    draw = random.Random(7)
    base = [f"w{draw.randrange(900)}" for _ in range(200)]
    near = base[:90] + ["changed"] + base[91:]
    other = [f"w{draw.randrange(900)}" for _ in range(200)]
    rows = [(2, " ".join(near)), (1, " ".join(base)), (3, " ".join(other)), (4, " ".join(base).upper())]
    kept = simhash.keep_one(frame(spark, rows), 5, 24, lanes=2, segments=4)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keep_one(spark, odd_rows):
    kept = simhash.keep_one(frame(spark, odd_rows), 5, 7)
    assert kept.columns == ["doc_id", "text", "digest", "kept"]
    prints = {(n, t): brute_fingerprint(t, 5) for n, t in odd_rows}
    of = brute_components(set(prints.values()), 7)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(of.values())) == len({of[prints[r]] for r in rows})
    for number, text in rows:
        mates = [n for (n, t), p in prints.items() if of[p] == of[prints[number, text]]]
        assert order((number, None)) == min(order((n, None)) for n in mates)


def test_two_lanes_and_wider_segments(spark):
    draw = random.Random(4)
    bases = [[draw.getrandbits(64), draw.getrandbits(64)] for _ in range(30)]
    values = {tuple(b) for b in bases}
    for base in bases:
        for _ in range(6):
            copy = list(base)
            for _ in range(draw.randint(1, 12)):
                copy[draw.randrange(2)] ^= 1 << draw.randrange(64)
            values.add(tuple(copy))
    signed = [([v - (1 << 64) if v >> 63 else v for v in pair],) for pair in sorted(values)]
    rows = spark.createDataFrame(signed, "fp array<bigint>").repartition(3)
    found = {tuple(r.node): tuple(r.component) for r in components.component_of(simhash.links(rows, 15, 2)).collect()}
    whole = [pair[0] << 64 | pair[1] for pair in values]
    groups, expected = {}, {}
    for pair, in signed:
        key = sum((x & (1 << 64) - 1) << s for x, s in zip(pair, (64, 0)))
        groups.setdefault(found.get(tuple(pair), tuple(pair)), set()).add(key)
    for value, root in brute_components(set(whole), 15).items():
        expected.setdefault(root, set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keep_one_with_clashing_names(spark):
    names = ["__key1", "__key2", "key1", "row", "place", "salt", "fp"]
    docs = frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, "x y z")]).selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    kept = simhash.keep_one(docs, 3, 2).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 120)]
    star = [(1000, i) for i in range(1001, 1300)]
    rows = spark.createDataFrame(chain + star + [(5000, 5000)], "a bigint, b bigint")
    found = {r.node: r.component for r in components.component_of(rows).collect()}
    assert found == {i: 0 for i in range(121)} | {i: 1000 for i in range(1000, 1300)}


def test_empty_tables(spark, odd_rows):
    none = frame(spark, odd_rows).where("doc_id = -1")
    assert line_dedup.dedup_lines(none).count() == 0
    assert substring_dedup.remove_repeats(none, cells=1 << 20).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none, 5, 7).count() == 0
