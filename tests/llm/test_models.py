"""Toxicity, importance resampling and URL judgement: held-out accuracy and stated rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import queries, resampling, toxicity, url_filter

WORDS = [f"word{i}" for i in range(300)]
RUDE = ["grunk", "blarg", "snerd"]


def texts(count, seed):
    draw = random.Random(seed)
    rows = []
    for number in range(count):
        words = [draw.choice(WORDS) for _ in range(draw.randint(5, 60))]
        bad = number % 4 == 0
        if bad:
            words[draw.randrange(len(words))] = draw.choice(RUDE) + draw.choice(["", ",", "!"])
        rows.append((number, " ".join(words).capitalize(), draw.choice(["en", "de", None]), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic(spark):
    rows = texts(1600, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    return docs, labels, rows


def test_toxicity_on_rows_it_did_not_learn_from(spark, toxic):
    docs, labels, rows = toxic
    model = toxicity.fit(docs, labels.where("doc_id < 1200").repartition(2))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] >= 1200]
    hits = sum((found[n].score >= toxicity.THRESHOLD) == bool(bad) for n, _, _, bad in held)
    assert hits >= 0.97 * len(held)
    assert sum(found[n].flagged == bool(bad) for n, _, _, bad in held) >= 0.97 * len(held)


def test_toxicity_of_odd_rows_and_clashing_columns(spark, toxic):
    docs, labels, _ = toxic
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, None, "a", 0.5), (None, "", "xx", "b", 0.5), (3, "grunk", "en", "c", 0.5), (3, "grunk", "en", "c", 0.5),
         (4, "word1 " * 50_000 + "grunk", "de", "d", 0.5)],
        "doc_id bigint, text string, lang string, __lang string, score double",
    )
    found = toxicity.score(odd, model).collect()
    by_id = {r.doc_id: r.score for r in found}
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert by_id[1] == by_id[None] < 0.5 < by_id[3]
    assert by_id[4] > 0.5
    assert toxicity.score(odd.where("doc_id = 99"), model).count() == 0


def test_toxicity_without_labels_of_both_classes(spark, toxic):
    docs, labels, _ = toxic
    for some, rate in ((labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("false"), 0.0)):
        scored = toxicity.score(docs, toxicity.fit(docs, some))
        assert scored.select("score").distinct().collect() == [(rate,)]


def test_toxic_words_of_few_texts_are_learnt(spark):
    draw = random.Random(3)
    rows = []
    for number in range(1600):
        words = [draw.choice(WORDS) for _ in range(draw.randint(5, 30))]
        if number % 4 == 0:  # 50 rude words, of eight texts each; five or six of them in the fit
            words[draw.randrange(len(words))] = f"rude{number // 4 % 50}"
        rows.append((number, " ".join(words), int(number % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, bad) for n, _, bad in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id < 1200"))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = rows[1200:]
    assert sum((found[n] >= 0.5) == bool(bad) for n, _, bad in held) >= 0.95 * len(held)


def test_toxicity_past_one_labelled_text_over_the_word_bound(spark, toxic):
    docs, labels, rows = toxic
    first = spark.createDataFrame([(n,) for n in range(5000, 9000)], "n bigint").orderBy(F.xxhash64("n")).first().n
    long = spark.createDataFrame([(first, "word1 " * 90_000, "en")], docs.schema)
    given = labels.where("doc_id < 1200").unionAll(spark.createDataFrame([(first, 0)], labels.schema))
    model = toxicity.fit(docs.unionAll(long), given, max_words=80_000)
    assert model.net is not None
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] >= 1200]
    assert sum((found[n] >= 0.5) == bool(bad) for n, _, _, bad in held) >= 0.95 * len(held)
    with pytest.raises(ValueError, match="bound"):
        toxicity.fit(docs, given, max_words=8)


def test_the_row_bound_leaves_out_labels_0_first(spark):
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 300 = 0 as int) as toxic")
    sample, stands_for = toxicity.labelled_sample(labels, 100)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {1: 10, 0: 90}
    assert stands_for == {1: 1.0, 0: pytest.approx(2990 / 90)}
    sample, _ = toxicity.labelled_sample(labels.selectExpr("doc_id", "1 - toxic as toxic"), 20)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {1: 15, 0: 5}


def test_toxicity_learns_from_and_calibrates_on_every_labelled_row(spark, monkeypatch):
    rows = [(n, f"word{n % 50} word{n % 7} " + ("grunk" if n % 4 == 0 else "fine"), "en", int(n % 4 == 0)) for n in range(9000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    counts, tags, calibrated = [], toxicity.row_tags, toxicity._calibrated
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "row_tags", lambda learnt: counts.append(learnt.count()) or tags(learnt))
    monkeypatch.setattr(toxicity, "_calibrated", lambda net, judged, times: counts.append(judged.count()) or calibrated(net, judged, times))
    toxicity.fit(docs, labels)
    assert sum(counts) == 9000 and 1500 < counts[1] < 2100


def test_toxicity_from_several_shards_and_blocks(spark, toxic, monkeypatch):
    docs, labels, rows = toxic
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 100)
    given = labels.where("doc_id < 1200")
    models = [toxicity.fit(docs.repartition(n), given, collected=0) for n in (1, 5)]
    found = {r.doc_id: r for r in toxicity.score(docs, models[0]).collect()}
    held = [r for r in rows if r[0] >= 1200]
    assert sum((found[n].score >= 0.5) == bool(bad) for n, _, _, bad in held) >= 0.97 * len(held)
    assert np.array_equal(models[0].net.flat(), models[1].net.flat())


def test_a_text_of_several_spans_pools_as_one(monkeypatch):
    draw = np.random.default_rng(0)
    tags = np.zeros(1 << toxicity.TABLE_BITS, np.uint32)
    tags[1:400] = 1
    net = toxicity.Network.fresh(tags)
    sizes = np.array([1, 70, 0, 500, 3])
    padded = toxicity._padded(draw.integers(1, 400, (2, sizes.sum())).astype(np.int32), sizes)
    whole = net.pooled(*padded, where=True)
    monkeypatch.setattr(toxicity, "SPAN", 16)
    cut = net.pooled(*padded, where=True)
    assert np.allclose(whole[0], cut[0], atol=1e-6)
    assert all(np.array_equal(a, b) for a, b in zip(whole[1], cut[1]))
    again = toxicity.Network.of_flat(tags, net.flat())
    assert np.array_equal(again.pooled(*padded)[0], cut[0])


def test_calibration_by_spark_is_that_of_the_driver(spark):
    draw = random.Random(5)
    rows = [(round(draw.gauss(bad, 1.2), 1), bad, lang) for bad, lang, n in
            [(0, "en", 300), (1, "en", 60), (0, None, 90), (1, None, 25), (0, "fr", 40), (1, "fr", 4)] for _ in range(n)]
    judged = spark.createDataFrame(rows, "margin double, label int, lang string").repartition(3)
    for times in ({0: 1.0, 1: 1.0}, {0: 2.5, 1: 1.25}):
        here, there = (f(None, judged, times) for f in (toxicity._calibrated, toxicity._calibrated_by_spark))
        assert there.slope == pytest.approx(here.slope) and there.shift == pytest.approx(here.shift)
        assert there.threshold == pytest.approx(here.threshold)
        assert set(here.thresholds) == {"en", None} and there.thresholds == pytest.approx(here.thresholds)


def test_weights_count_as_rows():
    scores, labels, times = np.array([0.9, 0.8, 0.6, 0.4, 0.1]), np.array([1, 0, 1, 0, 0]), np.array([1, 3, 2, 3, 1])
    many, of = np.repeat(scores, times), np.repeat(labels, times)
    assert toxicity.best_threshold(scores, labels, times) == pytest.approx(toxicity.best_threshold(many, of))


def test_thresholds_weigh_precision():
    scores, labels = np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 0, 0, 1])
    assert toxicity.best_threshold(scores, labels) == pytest.approx(0.75)


@pytest.fixture(scope="module")
def raw(spark):
    draw = random.Random(5)
    good = [f"fine{i}" for i in range(50)]
    junk = ["|", "###", "$$$", "zz"]
    rows = [
        (n, " ".join(draw.choice(good if n % 2 else junk) for _ in range(draw.randint(3, 90)))) for n in range(600)
    ] + [(1000, None), (1001, ""), (None, "fine1 fine2"), (1002, "fine3 " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(n, n % 2) for n in range(0, 200)] + [(3, None), (None, 1)], "doc_id bigint, quality int")
    return docs, labels, rows


def test_resampling_prefers_what_the_target_is_like(spark, raw):
    docs, labels, rows = raw
    kept = resampling.resample(docs, labels).collect()
    assert len(kept) == math.ceil(len(rows) / 2)
    ids = {r.doc_id for r in kept}
    assert sum(n % 2 for n in range(600) if n in ids) > 0.95 * sum(n in ids for n in range(600))
    again = {r.doc_id for r in resampling.resample(docs.repartition(5), labels).collect()}
    assert again == ids


def test_resampling_weights_by_hand(spark, raw):
    docs, labels, rows = raw
    import pyarrow as pa

    counts = np.zeros((2, resampling.BUCKETS))
    for number, text in rows:
        buckets, _ = resampling.gram_buckets(pa.array([text or ""]))
        for model in (0, 1) if number is not None and number < 200 and number % 2 else (0,):
            np.add.at(counts[model], buckets, 1)
    ratios = resampling.log_ratios(counts)
    for row in resampling.weighted(docs, ratios).collect():
        text = dict(rows)[row.doc_id]
        buckets, _ = resampling.gram_buckets(pa.array([text or ""]))
        assert row.log_weight == pytest.approx(ratios[buckets].sum())


def test_gumbel_noise_samples_in_proportion(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as text")
    import pyarrow as pa

    ratios = np.zeros(resampling.BUCKETS)
    ratios[resampling.gram_buckets(pa.array(["a"]))[0]] = math.log(4)
    rows = resampling.weighted(docs, ratios).collect()
    top = sorted(rows, key=lambda r: -r.key)[:600]
    share = sum(r.doc_id % 3 == 0 for r in top) / len(top)
    assert abs(share - 4 / 6) < 0.08


@pytest.mark.parametrize("k", [0, 1, 17, 500, 999, 1000, 2000])
def test_top_k_is_exact_with_ties(spark, k):
    draw = random.Random(k)
    values = [draw.choice([draw.gauss(0, 1), 0.25, -1e300, 5e-324]) for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "key double").repartition(4)
    found = sorted((r.key for r in resampling.top_k(rows, k).collect()), reverse=True)
    assert found == sorted(values, reverse=True)[:k]


def test_resampling_of_nothing_and_without_target(spark, raw):
    docs, labels, rows = raw
    assert resampling.resample(docs.where("false"), labels).count() == 0
    kept = resampling.resample(docs, labels.where("false")).collect()
    assert len(kept) == math.ceil(len(rows) / 2) and all(r.log_weight == 0 for r in kept)


URLS = [
    ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://EXAMPLE.net/en/?q=1#x", "example.net", "/en/", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://myexample.com/de/1", "myexample.com", "/de/1", None, None),
    ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://b.net", "b.net", "", None, None),
    ("http://b.net?x=/", "b.net", "", None, None),
    ("http://É.Net/a", "É.net", "/a", "net/", "block"),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
    ("http://", "", "", None, None), ("http://h\n.net/\n", "h\n.net", "/\n", "net/", "block"),
    ("http://long.net/" + "a1" * 20_000, "long.net", "/" + "a1" * 20_000, "net/", "block"),
]


def test_url_rules_and_odd_rows(spark):
    rows = [(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    found = url_filter.judge(pages).collect()
    assert len(found) == len(rows)
    for row in found:
        _, host, path, rule, verdict = URLS[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")
        assert (row.score is None) == (rule is not None)


def test_urls_without_labels_and_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in url_filter.judge(pages).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false")).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/")], "page_id bigint, url string")
    assert {r.verdict for r in url_filter.judge(one).collect()} == {"block"}


def test_trees_learn_from_labelled_urls(spark):
    draw = random.Random(8)
    rows = []
    for number in range(900):
        bad = draw.random() < 0.5
        word = "".join(draw.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        rows.append((number, bad, f"http://{word}.com/{'x' if number >= 600 else 'ab'[bad]}/{number}"))
    pages = spark.createDataFrame([(n, u) for n, _, u in rows], "page_id bigint, url string")
    rules = (url_filter.Rule("block", "com/b/"), url_filter.Rule("allow", "com/a/"))
    found = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    rest = [(n, bad) for n, bad, _ in rows if n >= 600]
    assert all(found[n].rule is None for n, _ in rest)
    assert sum((found[n].verdict == "block") == bad for n, bad in rest) > 0.95 * len(rest)


def test_urls_of_any_frequent_or_rare_suffix_have_its_rate(spark):
    """1,500 hosts, each with labelled urls of one verdict: only the host's own rate tells it."""
    rows = [
        (f"http://h{host:04d}.com/{'ab'[host % 2] if place < 6 else 'x'}/{place}", place)
        for host in range(1500) for place in range(8)
    ]
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(rows)], "page_id bigint, url string")
    rules = (url_filter.Rule("block", "com/b/"), url_filter.Rule("allow", "com/a/"))
    one = url_filter.judge(pages, rules).where("rule is null").collect()
    assert len(one) == 3000
    assert sum((r.verdict == "block") == bool(int(r.host[1:5]) % 2) for r in one) > 0.99 * len(one)
    shuffled = url_filter.judge(pages, rules, most_bytes=0).where("rule is null").collect()
    assert {(r.page_id, r.verdict, round(r.score, 9)) for r in shuffled} == {
        (r.page_id, r.verdict, round(r.score, 9)) for r in one
    }


def test_a_labelled_url_does_not_count_in_its_own_rate(spark):
    urls = [("http://one.com/b/1", 1.0), ("http://two.com/b/1", 1.0), ("http://two.com/b/2", 1.0), ("http://no.com/", None)]
    rows = spark.createDataFrame([(u, u.split("/")[2], y) for u, y in urls], "url string, __last_two string, __label double")
    rates = {r["__last_two"]: r for r in url_filter.suffix_rates(rows, "__last_two", 0.5).collect()}
    assert len(rates) == 3 and rates["no.com"].rate == 0.5
    assert rates["one.com"].rate == pytest.approx(6 / 11) and min(rates["one.com"].others) == 0.5
    assert rates["two.com"].rate == pytest.approx(7 / 12) and max(rates["two.com"].others) == pytest.approx(7 / 12)


def test_url_sample_holds_distinct_urls_of_both_verdicts(spark):
    rows = [("http://hot.com/a/1", 0.0)] * 5_000 + [(f"http://h{n}.com/{'ab'[n % 9 == 0]}/", float(n % 9 == 0)) for n in range(3_000)]
    labelled = spark.createDataFrame(rows, "url string, __label double").repartition(4)
    chosen = url_filter.weighted_sample(labelled, 1_000).collect()
    weights = {r.url: r["__weight"] for r in chosen}
    assert len(chosen) == len(weights) == 1_000  # no url twice
    assert sum(r["__label"] == 1 for r in chosen) == 334  # all there are
    assert weights["http://hot.com/a/1"] == 5_000
    assert sum(weights.values()) == pytest.approx(8_000, rel=0.02)
    few = url_filter.weighted_sample(labelled, 2).collect()
    assert {r["__label"] for r in few} == {0.0, 1.0}
    whole = url_filter.weighted_sample(labelled, 5_000).collect()
    assert len(whole) == 3_001 and sum(r["__weight"] for r in whole) == 8_000


def test_a_hot_labelled_url_leaves_the_others_in_the_fit(spark):
    urls = spark.range(1000).selectExpr("concat('http://hot.com/a/', id) as url")
    hot = urls.orderBy(F.xxhash64("url")).first().url  # first in hash order
    rows = [hot] * 600 + [f"http://{'123456'[n % 6] * 9 if n % 2 else 'abcdef'[n % 6] * 9}.com/{'ab'[n % 2] if n < 60 else 'x'}/{n}" for n in range(90)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    rules = (url_filter.Rule("block", "com/b/"), url_filter.Rule("allow", "com/a/"))
    found = [r for r in url_filter.judge(pages, rules, max_rows=100).collect() if r.rule is None]
    assert len(found) == 30
    assert all(r.verdict == ("block" if r.host[0].isdigit() else "allow") for r in found)


def test_entropy(spark):
    rows = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "t string")
    found = [round(r[0], 9) for r in rows.select(url_filter.entropy(rows.t)).collect()]
    assert found == [1.0, 0.0, 2.0]


def test_held_out_toxicity_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"  # the smaller ones have a few hundred labels
    found = queries.op1_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.94 * len(held)
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.55 * len(toxic)
