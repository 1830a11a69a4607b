"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with
the rule's, and the longest fitting rule decides. The urls that a rule decides are the labelled ones:
boosted trees learn from them (length, depth, digit ratio, entropy, parameter counts, statistics
of host suffixes) and judge the others. All of it is DataFrame work: the features are column
expressions and the trees are Spark ML's.

The trees are fitted on at most ``MAX_ROWS`` distinct labelled urls, half of them of each verdict as far as
there are so many, each weighted by its rows. Beyond that a priority sample is drawn by a hash of the url: urls with
many rows are all in it and the others stand for those left out, so sums of weights are right on average.
Suffix statistics cover all labelled urls and are kept for every suffix these have; a suffix without
labelled urls has the overall rate. The statistic of a labelled url leaves out its own fold (of ``FOLDS``, by a
hash of the url), or a suffix with one url would tell that url's label. The table of suffixes is
broadcast up to ``BROADCAST_BYTES`` and joined by shuffle beyond, suffixes with more than one of ``HOT``
rows over ``SALTS`` groups each.

A null url, or one without "://", has an empty host and path and fits no rule; it is judged by its
other features. Rows that repeat are judged alike. Without labelled urls of both verdicts the
rest gets the one verdict there is, or "allow". Columns named as the results are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.columns import let
from assayline.session import materialise

MAX_ROWS = 20_000
PRIOR_ROWS = 10.0
FOLDS = 5
BROADCAST_BYTES = 16 * 1024 * 1024
HOT = 1_000
SALTS = 16
TREES = 20
DEPTH = 4
SEED = 5
RESULTS = ("host", "path", "rule", "score", "verdict")


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    text: str  # host/path, such as "example.net/en/"

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("block", "net/"), Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"), Rule("allow", "org/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def _longest(rules, value) -> Column:
    """``value`` of the longest rule that fits, null if none does; equal lengths go by text."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        chosen = F.when(_fits(rule), F.lit(value(rule))).otherwise(chosen)
    return chosen


def _count(text: Column, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character frequencies."""
    size = F.length(text).cast("double")

    def bits(pair: Column) -> Column:
        return F.aggregate(F.array_distinct(pair["signs"]), F.lit(0.0), lambda total, sign: let(
            (F.length(pair["text"]) - F.length(F.replace(pair["text"], sign, F.lit("")))) / pair["size"],
            lambda share: total - share * F.log2(share),
        ))

    signs = F.filter(F.split(text, ""), lambda c: c != "")
    return let(F.struct(signs.alias("signs"), text.alias("text"), size.alias("size")), bits)


LEXICAL = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digits",
    "hyphens", "entropy", "parameters", "fragment", "secure",
)
SUFFIXES = ("last", "last_two")


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the host's suffixes (columns ``__...``)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_depth": _count(host, "."),
        "path_depth": _count(path, "/"),
        "digit_ratio": _count(url, string.digits) / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _count(host, string.digits),
        "hyphens": _count(host, "-"),
        "entropy": entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "fragment": url.contains("#").cast("double"),
        "secure": url.startswith("https").cast("double"),
    }
    return urls.withColumns({f"__{k}": v for k, v in values.items()} | {
        "__last": F.substring_index("host", ".", -1), "__last_two": F.substring_index("host", ".", -2),
    })


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def suffix_rates(features: DataFrame, suffix: str, base: float) -> DataFrame:
    """Smoothed rates of "block" of every value of a suffix column: ``rate`` over its labelled urls,
    ``others`` over those outside each fold; with the counts of its labelled (``n``) and all rows."""
    given, label = F.col("__label").isNotNull(), F.col("__label")
    inside = [F.struct(
        F.count_if(given & (_fold() == k)).alias("n"),
        F.coalesce(F.sum(F.when(_fold() == k, label)), F.lit(0.0)).alias("blocked"),
    ) for k in range(FOLDS)]
    counts = features.groupBy(suffix).agg(
        F.count("*").alias("rows"), F.count("__label").alias("n"),
        F.coalesce(F.sum("__label"), F.lit(0.0)).alias("blocked"), F.array(*inside).alias("folds"),
    )

    def rate(blocked: Column, n: Column) -> Column:
        return (blocked + base * PRIOR_ROWS) / (n + PRIOR_ROWS)

    others = F.transform("folds", lambda f: rate(F.col("blocked") - f["blocked"], F.col("n") - f["n"]))
    return counts.select(suffix, "rows", "n", rate(F.col("blocked"), F.col("n")).alias("rate"), others.alias("others"))


def with_rate(features: DataFrame, rates: DataFrame, suffix: str, base: float, most_bytes: int) -> DataFrame:
    """``features`` (with a row number ``__row``) and the rate of their suffix; ``rates`` is written."""
    known = rates.where("n > 0").select(suffix, "rate", "others", "rows")
    total, size = rates.agg(F.sum("rows"), F.sum(F.octet_length(suffix) + F.lit(16 * (FOLDS + 4)))).first()
    if (size or 0) <= most_bytes:
        joined = features.join(F.broadcast(known.drop("rows")), suffix, "left")
    else:
        hot = F.col("rows") * HOT > total
        often = rates.where(hot).select(suffix, F.lit(True).alias("__hot"))  # fewer than HOT rows
        last = F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("bigint")
        dealt = known.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("rows")
        salt = F.when(F.col("__hot"), F.pmod("__row", F.lit(SALTS))).otherwise(F.lit(0)).cast("bigint")
        joined = features.join(F.broadcast(often), suffix, "left").withColumn("__salt", salt)
        joined = joined.join(dealt, [suffix, "__salt"], "left").drop("__salt", "__hot")
    rate = F.when(F.col("rule").isNull(), F.col("rate")).otherwise(F.element_at("others", _fold() + 1))
    return joined.withColumn(f"{suffix}_rate", F.coalesce(rate, F.lit(base))).drop("rate", "others")


def weighted_sample(labelled: DataFrame, size: int) -> DataFrame:
    """At most ``size`` distinct urls (two at least) with ``__label`` and ``__weight``, both labels among them.

    A url's priority is its rows by a uniform number from its hash; the first are taken and weigh their
    rows or, if that is more, the priority of the first one left out.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("url"), 11) + 0.5) / 2.0**53
    urls = labelled.groupBy("url", "__label").agg(F.count("*").cast("double").alias("__weight"))
    urls = materialise(urls.withColumn("__priority", F.col("__weight") / uniform), "distinct-urls")
    sizes = {row["__label"]: row["count"] for row in urls.groupBy("__label").count().collect()}
    parts = []
    for label, other in ((0.0, 1.0), (1.0, 0.0)):
        count = min(sizes[label], max(size // 2, size - sizes[other]))
        order = urls.where(F.col("__label") == label).orderBy(F.desc("__priority"), "url")
        least = 0.0
        if count < sizes[label]:
            least = order.select("__priority").limit(count + 1).agg(F.min("__priority")).first()[0]
        parts.append(order.limit(count).withColumn("__weight", F.greatest("__weight", F.lit(least))))
    return materialise(parts[0].unionAll(parts[1]).drop("__priority"), "sampled-urls")


def judge(
    urls: DataFrame, rules=RULES, max_rows: int = MAX_ROWS, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``urls`` (column ``url``) with host, path, rule, score (of "block", null where a rule
    decides) and verdict."""
    own = [c for c in urls.columns if c.lower() not in RESULTS]
    parsed = urls.select(*own).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parsed.withColumns({
        "rule": _longest(rules, lambda r: r.text),
        "__label": (_longest(rules, lambda r: r.verdict) == "block").cast("double"),
    })
    # the row number is written, so a task that runs again deals its rows out alike
    features = materialise(with_features(ruled).withColumn("__row", F.monotonically_increasing_id()), "urls")
    labelled = features.where("rule is not null")
    base, least, most = labelled.agg(F.avg("__label"), F.min("__label"), F.max("__label")).first()
    if base is None or least == most:
        rest = F.lit("block" if base else "allow")
        return features.select(
            *own, "host", "path", "rule", F.lit(base).cast("double").alias("score"),
            F.when(F.col("__label") == 1, "block").when(F.col("__label") == 0, "allow").otherwise(rest).alias("verdict"),
        )
    chosen = weighted_sample(labelled, max_rows).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    sample = with_features(chosen.withColumn("rule", _longest(rules, lambda r: r.text)))
    sample = sample.withColumn("__row", F.monotonically_increasing_id())
    for suffix in SUFFIXES:
        rates = materialise(suffix_rates(features.select("url", f"__{suffix}", "__label"), f"__{suffix}", base), "suffixes")
        features = with_rate(features, rates, f"__{suffix}", base, most_bytes)
        sample = with_rate(sample, rates, f"__{suffix}", base, most_bytes)
    inputs = [*(f"__{k}" for k in LEXICAL), *(f"__{s}_rate" for s in SUFFIXES)]
    assembler = VectorAssembler(inputCols=inputs, outputCol="__features")
    vectors = assembler.transform(features)
    sample = materialise(assembler.transform(sample).select("__features", "__label", "__weight"), "labelled-urls")
    learner = GBTClassifier(
        featuresCol="__features", labelCol="__label", predictionCol="__prediction", weightCol="__weight",
        maxIter=TREES, maxDepth=DEPTH, seed=SEED,
    ).setRawPredictionCol("__raw").setProbabilityCol("__probability")
    trees = learner.fit(sample)
    score = F.when(F.col("rule").isNull(), vector_to_array("__probability")[1])
    label = F.coalesce("__label", F.col("__prediction"))
    return trees.transform(vectors).select(
        *own, "host", "path", "rule", score.alias("score"),
        F.when(label == 1, "block").otherwise("allow").alias("verdict"),
    )
