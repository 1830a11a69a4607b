"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (A-Z lower-cased, cut at white space and ASCII punctuation) is the sum of two rows of
a hashed embedding table; a row is tagged with the word it was trained for, so that words never met add nothing. Filters of several widths run over all words of a text, each is
pooled by its maximum, and a logistic layer reads the maxima; a text of any length is scored
whole. Scores are calibrated on labelled rows kept out of the fit, and a threshold is set for each
language there.

The fit reads every labelled row. Rows are dealt into shards by a hash of the id, of some ``SHARD_ROWS``
each, in the order of that hash. A task trains on its shard by mini-batches, drawn at random inside blocks of
``BLOCK_ROWS`` rows or ``BLOCK_WORDS`` words, which is all it holds. After each epoch the weights of the shards are averaged, each by
the shards that moved it; what reaches the driver is one model, of fixed size. One block is fitted in one
task. Calibration and thresholds use all rows kept out: beyond ``COLLECTED`` of them their sums and cuts are taken by Spark.
``max_rows`` and ``max_words`` bound the fit if asked: rows of label 1 come first (a quarter is left to label 0), texts of more
than one of ``LONGEST`` of the words are left out by themselves, and where the bound on words leaves fewer than two of the given labels, the
fit fails; calibration and thresholds then weigh rows as what they stand for.
What is sent to the tasks is the model, of fixed size. Scoring is one pass over the documents without a shuffle.

Null text is an empty one; an empty text gets the score of "no word at all". Labels that are
null, or other than 0 and 1, or whose document is missing don't count; a document labelled both
ways counts as often as it is labelled. Without labels of both classes every score is the rate of label
1 (0 if there is none). A null language is a language of its own.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assayline.llm import kernels
from assayline.operators.metrics import probability_edges, ranked_cells, score_cells
from assayline.session import materialise

TABLE_BITS = 18
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 32
RATE = 0.01
DECAY = 1e-2
#: Words of one fit text only are not learnt: README.md has what they cost on held-out rows.
MIN_TEXTS = 2
SEED = 7
#: Labelled rows of one training task, and what it holds of them at once.
SHARD_ROWS = 32_768
BLOCK_ROWS = 8192
BLOCK_WORDS = 2_000_000
LONGEST = 8
#: Calibrating rows that are brought to the driver, a margin and a label each.
COLLECTED = 1 << 18
#: Labelled rows that are sent to the documents; more of them meet in a shuffled join.
BROADCAST_LABELS = 1 << 19
#: Texts that go to Python at once while the model is fitted.
BATCH_TEXTS = 256
#: Places whose responses are held at once.
SPAN = 1 << 18
#: Weights in one row of a shard's result.
_PART = 1 << 14
#: Of five labelled rows one calibrates the score and the thresholds.
CALIBRATION = 5
THRESHOLD = 0.7
#: A language with fewer calibrating rows of label 1 takes the threshold of all languages.
MIN_POSITIVES = 10

_PUNCTUATION = string.punctuation.encode()
_PAD = 2  # words of nothing after each text


def _rows_and_tags(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.uint64((1 << TABLE_BITS) - 1)
    rows = np.stack((hashes % count, (hashes >> np.uint64(20)) % count)).astype(np.int32) + 1
    return rows, (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def row_tags(learnt: DataFrame) -> np.ndarray:
    """Which word each embedding row is for: words that ``MIN_TEXTS`` texts hold take both their
    rows, frequent ones last. A word of one text could only be learnt by heart."""
    high = np.uint64(1 << 63)  # numbers without a sign, in the order of those with one

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.unique(t) for t in _lists(batch.column("words"))]
            found, counts = np.unique(np.concatenate(texts), return_counts=True) if texts else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["hash", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            rows, marks = _rows_and_tags(hashes)
            for second in (0, 1):
                columns = [rows[second], np.full(len(hashes), second, np.int32), batch.column("n").to_numpy(),
                           (hashes ^ high).view(np.int64), marks.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["slot", "second", "n", "key", "mark"])

    counted = learnt.select("words").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    placed = counted.where(F.col("n") >= MIN_TEXTS).mapInArrow(
        place, "slot int, second int, n bigint, key bigint, mark bigint"
    )
    last = placed.groupBy("slot").agg(F.max_by("mark", F.struct("second", "n", "key")).alias("mark"))
    found = last.toArrow()  # at most a row for each of the table's
    tags = np.zeros(1 << TABLE_BITS, np.uint32)
    tags[found.column("slot").to_numpy()] = found.column("mark").to_numpy().astype(np.uint32)
    return tags


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def word_rows(hashes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The two embedding rows of each word, one above the other; 0, the row of no word, where
    the row is for another word."""
    rows, marks = _rows_and_tags(hashes)
    return np.where(tags[rows] == marks, rows, 0)


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts of ``sizes`` words begin once padded, and how many places each has."""
    places = np.maximum(sizes, 1)
    begin = np.concatenate(([0], np.cumsum(places + _PAD)))
    return begin, places


def _padded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin, places = _layout(sizes)
    out = np.zeros((2, begin[-1] + _PAD), np.int32)
    at = np.repeat(begin[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(rows.shape[1])
    out[:, at] = rows
    return out, begin[:-1], places


@dataclass
class Network:
    """Embeddings, filters by width, and the logistic layer."""

    tags: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]  # width * DIMENSIONS x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(tags: np.ndarray) -> Network:
        draw = np.random.default_rng(SEED)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        # row 0 is that of no word and stays zero
        table = normal(1 << TABLE_BITS, DIMENSIONS, scale=0.03)
        table[0] = 0
        return Network(
            tags,
            table,
            [normal(w * DIMENSIONS, FILTERS, scale=0.3) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            normal(len(WIDTHS) * FILTERS, scale=0.3),
            np.zeros(1, np.float32),
        )

    def parts(self) -> Iterator[np.ndarray]:
        """All weights that words can reach, as one array cut into ``_PART`` each; no second copy is made."""
        live = np.flatnonzero(self.tags)
        size = len(live) * DIMENSIONS
        dense = np.concatenate([x.ravel() for x in (*self.filters, *self.biases, self.weights, self.bias)])
        for a in range(0, size + len(dense), _PART):
            reached = self.table[live[a // DIMENSIONS : (a + _PART) // DIMENSIONS]].ravel()
            yield np.concatenate((reached, dense[max(a - size, 0) : max(a + _PART - size, 0)]))

    def flat(self) -> np.ndarray:
        return np.concatenate([*self.parts()])

    @staticmethod
    def of_flat(tags: np.ndarray, values: np.ndarray) -> Network:
        live = np.flatnonzero(tags)
        table = np.zeros((1 << TABLE_BITS, DIMENSIONS), np.float32)
        table[live] = values[: len(live) * DIMENSIONS].reshape(-1, DIMENSIONS)
        shapes = [*[(w * DIMENSIONS, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (len(WIDTHS) * FILTERS,), (1,)]
        ends = np.cumsum([np.prod(x) for x in shapes])
        pieces = np.split(values[len(live) * DIMENSIONS :].copy(), ends[:-1])
        dense = [x.reshape(shape) for x, shape in zip(pieces, shapes)]
        n = len(WIDTHS)
        return Network(tags, table, dense[:n], dense[n : 2 * n], *dense[2 * n :])

    def pooled(self, rows: np.ndarray, begin: np.ndarray, places: np.ndarray, where: bool = False):
        """Largest response of every filter in every text, after the rectifier; with ``where``
        also the place it comes from. ``SPAN`` places at a time, so that a long text costs no more."""
        end, total = begin + places, rows.shape[1] - _PAD
        values = [np.full((len(begin), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        sources = [np.zeros((len(begin), FILTERS), np.int64) for _ in WIDTHS] if where else []
        for low in range(0, total, SPAN):
            n = min(SPAN, total - low)
            first, last = np.searchsorted(end, low, "right"), np.searchsorted(begin, low + n)
            if first == last:
                continue
            part = slice(low, low + n + _PAD)
            words = self.table[rows[0, part]] + self.table[rows[1, part]]
            inside = np.maximum(begin[first:last] - low, 0), np.minimum(end[first:last] - low, n)
            bounds = np.stack(inside, axis=1).ravel()
            for k, (width, matrix) in enumerate(zip(WIDTHS, self.filters)):
                response = sum(
                    words[o : o + n] @ matrix[o * DIMENSIONS : (o + 1) * DIMENSIONS] for o in range(width)
                )
                response = np.concatenate((response, np.full((_PAD, FILTERS), -np.inf, np.float32)))
                top = np.maximum.reduceat(response, bounds, axis=0)[::2]
                before = values[k][first:last]
                if where:
                    at = np.stack([low + a + response[a:b].argmax(0) for a, b in zip(*inside)])
                    sources[k][first:last] = np.where(top > before, at, sources[k][first:last])
                values[k][first:last] = np.maximum(before, top)
        return np.concatenate([np.maximum(v + bias, 0) for v, bias in zip(values, self.biases)], 1), sources

    def margins(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros(0)
        pooled, _ = self.pooled(*_padded(rows, sizes))
        return (pooled @ self.weights + self.bias).astype(np.float64)


class _Adam:
    def __init__(self, shape):
        self.mean, self.square = np.zeros(shape, np.float32), np.zeros(shape, np.float32)

    def step(self, values: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        """Move ``values[at]``; rows outside ``at`` and their moments stay (lazy update)."""
        self.mean[at] = 0.9 * self.mean[at] + 0.1 * gradient
        self.square[at] = 0.99 * self.square[at] + 0.01 * gradient**2
        values[at] -= RATE * self.mean[at] / (np.sqrt(self.square[at]) + 1e-6)


class _Training:
    """A network under mini-batches and the moments of its weights."""

    def __init__(self, net: Network, rate: float, draw: np.random.Generator):
        self.net, self.draw = net, draw
        self.balance = np.array([0.5 / (1 - rate), 0.5 / rate])
        self.table = _Adam(net.table.shape)
        self.dense = [_Adam(x.shape) for x in [*net.filters, *net.biases, net.weights, net.bias]]

    def epoch(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Once over a block; ``rows`` are the embedding rows of each text's words."""
        net, balance = self.net, self.balance[labels]
        order = self.draw.permutation(len(rows))
        for chosen in np.array_split(order, -(-len(order) // BATCH)):
            sizes = np.array([rows[i].shape[1] for i in chosen])
            padded, begin, places = _padded(np.concatenate([rows[i] for i in chosen], axis=1), sizes)
            pooled, sources = net.pooled(padded, begin, places, where=True)
            margin = pooled @ net.weights + net.bias
            error = (1 / (1 + np.exp(-margin)) - labels[chosen]) * balance[chosen] / len(chosen)
            error = error.astype(np.float32)
            back = error[:, None] * net.weights * (pooled > 0)
            filter_steps, bias_steps, touched, pushes = [], [], [], []
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                matrix, step = net.filters[k], np.zeros_like(net.filters[k])
                for o in range(width):
                    at = sources[k] + o  # texts x filters
                    words = net.table[padded[0, at]] + net.table[padded[1, at]]
                    span = slice(o * DIMENSIONS, (o + 1) * DIMENSIONS)
                    step[span] = np.einsum("tfd,tf->df", words, part)
                    push = (part[:, :, None] * matrix[span].T[None]).reshape(-1, DIMENSIONS)
                    touched += [padded[0, at].ravel(), padded[1, at].ravel()]
                    pushes += [push, push]
                filter_steps.append(step)
                bias_steps.append(part.sum(0))
            gradients = [*filter_steps, *bias_steps, pooled.T @ error, error.sum(keepdims=True)]
            for values, moments, gradient in zip(
                [*net.filters, *net.biases, net.weights, net.bias], self.dense, gradients
            ):
                moments.step(values, gradient)
            at, number = np.unique(np.concatenate(touched), return_inverse=True)
            summed = np.zeros((len(at), DIMENSIONS), np.float32)
            np.add.at(summed, number, np.concatenate(pushes))
            real = at > 0
            at, summed = at[real], summed[real] + DECAY * net.table[at[real]]
            self.table.step(net.table, summed, at)


def _round(learnt: DataFrame, tags: np.ndarray, start: np.ndarray, rate: float, epochs: int, seed: list[int]) -> np.ndarray:
    """The weights after every shard has trained from ``start`` on its own, averaged."""
    sent = learnt.sparkSession.sparkContext.broadcast((tags, start))

    def trained(shard: int, texts: Iterator[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng([*seed, shard] if len(seed) > 1 else seed[0])
        training = _Training(Network.of_flat(*sent.value), rate, draw)
        rows, labels, words, count = [], [], 0, 0
        for hashes, label in texts:
            if rows and (len(rows) == BLOCK_ROWS or words + len(hashes) > BLOCK_WORDS):
                training.epoch(rows, np.array(labels))
                rows, labels, words = [], [], 0
            rows.append(word_rows(hashes, training.net.tags))
            labels.append(label)
            words, count = words + len(hashes), count + 1
        for _ in range(epochs):
            training.epoch(rows, np.array(labels))
        for number, part in enumerate(training.net.parts()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([count], pa.int64()), pa.array([number], pa.int32()),
                 pa.array([part.tobytes()], pa.binary())],
                ["shard", "rows", "part", "values"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in itertools.groupby(_labelled(batches), key=lambda row: row[0]):
            yield from trained(shard, ((hashes, label) for _, hashes, label in group))

    def average(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        before = sent.value[1][number * _PART : (number + 1) * _PART]
        total, weight = np.zeros(len(before)), np.zeros(len(before))
        for row in part.sort_by([("shard", "ascending"), ("rows", "ascending")]).to_pylist():
            values = np.frombuffer(row["values"], np.float32)
            moved = values != before
            total += np.where(moved, values.astype(np.float64) * row["rows"], 0)
            weight += moved * row["rows"]
        mean = np.where(weight > 0, total / np.maximum(weight, 1), before).astype(np.float32)
        return pa.table({"part": pa.array([number], pa.int32()), "values": pa.array([mean.tobytes()], pa.binary())})

    shards = learnt.select("shard", "label", "words").mapInArrow(learn, "shard bigint, rows bigint, part int, values binary")
    found = shards.groupBy("part").applyInArrow(average, "part int, values binary").toArrow().sort_by("part")
    sent.destroy()
    return np.frombuffer(b"".join(found.column("values").to_pylist()), np.float32)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(shard, hashes, label) of every row."""
    for batch in batches:
        shards, labels = batch.column("shard").to_pylist(), batch.column("label").to_pylist()
        for shard, words, label in zip(shards, _lists(batch.column("words")), labels):
            yield shard, words.view(np.uint64), label


def train(learnt: DataFrame, rate: float, one_block: bool) -> Network:
    """Fit by mini-batches to ``learnt`` (shard, label, words), of which ``rate`` have label 1."""
    tags = row_tags(learnt)
    values = Network.fresh(tags).flat()
    if one_block:
        values = _round(learnt, tags, values, rate, EPOCHS, [SEED])
    else:
        for number in range(EPOCHS):
            values = _round(learnt, tags, values, rate, 1, [SEED, number])
    return Network.of_flat(tags, values)


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Slope and shift by Newton steps; ``sums`` are the curvature and the slope of the loss at them."""
    w = np.array([1.0, 0.0])
    for _ in range(50):
        hessian, gradient = sums(w)
        move = np.linalg.solve(hessian + 1e-6 * np.eye(2), gradient)
        w -= move * min(1, 2 / np.abs(move).max())
        if np.abs(move).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _targets(count: float, ones: float) -> tuple[float, float]:
    """What rows of label 0 and 1 are fitted to, drawn in as by Platt, so separable rows keep finite values."""
    return 1 / (count - ones + 2), (ones + 1) / (ones + 2)


def platt(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * margin + shift) a probability."""
    weights = np.ones(len(labels)) if weights is None else weights / weights.mean()
    zero, one = _targets(len(labels), labels.sum())
    target = np.where(labels == 1, one, zero)
    x = np.stack((margins, np.ones(len(margins))), axis=1)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-x @ w))
        return (x * (weights * p * (1 - p))[:, None]).T @ x, x.T @ (weights * (p - target))

    return _newton(sums)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Midway in the gap below the cut with the best F0.5, which weighs precision over recall."""
    weights = np.ones(len(labels)) if weights is None else weights
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum((weights * labels)[order])
    taken = np.cumsum(weights[order])
    quality = 1.25 * hits / (taken + 0.25 * hits[-1])
    ranked = scores[order]
    quality[:-1][ranked[:-1] == ranked[1:]] = -1  # no cut within ties
    best = int(np.argmax(quality))
    after = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return float((ranked[best] + after) / 2)


@dataclass
class ToxicityModel:
    net: Network | None
    slope: float
    shift: float
    thresholds: dict[str | None, float]
    threshold: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -50, 50)))


def _word_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with the text replaced by ``words``, the hashes of its words."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernels.chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                words = kernels.words_of(part.column("text"), lower=True, also=_PUNCTUATION)
                lists = pa.ListArray.from_arrays(
                    pa.array(words.first.astype(np.int32)), pa.array(words.hashes.view(np.int64))
                )
                order = part.column("order").to_numpy().view(np.uint64)
                calibrates = kernels.mix(order) % np.uint64(CALIBRATION) == 0
                kept = ("shard", "order", "label", "lang")
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, kept), pa.array(calibrates), pa.array(np.diff(words.first)), lists],
                    [*kept, "calibrates", "size", "words"],
                )

    return docs.mapInArrow(
        convert, "shard bigint, order bigint, label int, lang string, calibrates boolean, size bigint, words array<bigint>"
    )


def _valid(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))


def labelled_sample(labels: DataFrame, size: int) -> tuple[DataFrame, dict[int, float]]:
    """At most ``size`` rows (doc_id, label), and how many labelled rows one of each label stands for."""
    valid = _valid(labels)
    totals = {0: 0, 1: 0} | {row["label"]: row["count"] for row in valid.groupBy("label").count().collect()}
    ones = min(totals[1], max(size - totals[0], size - size // 4))
    take = {1: ones, 0: min(totals[0], size - ones)}
    first, second = (
        valid.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in take.items()
    )
    return first.unionAll(second), {k: totals[k] / n if n else 1.0 for k, n in take.items()}


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int | None = None, max_words: int | None = None, collected: int = COLLECTED
) -> ToxicityModel:
    """A model from all ``labels`` (doc_id, toxic) and the texts and languages of ``docs``, unless bounded."""
    with _small_batches(docs.sparkSession):
        return _fitted(docs, labels, max_rows, max_words, collected)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_TEXTS`` rows for what runs inside, read and sent to Python: texts and their words are long rows."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, str(BATCH_TEXTS))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _fitted(docs: DataFrame, labels: DataFrame, max_rows: int | None, max_words: int | None, collected: int) -> ToxicityModel:
    sample, stands_for = labelled_sample(labels, max_rows) if max_rows else (_valid(labels), {0: 1.0, 1: 1.0})
    listed = sample.count()
    shards = -(-listed // SHARD_ROWS) or 1
    if listed <= BROADCAST_LABELS:
        sample = F.broadcast(sample)
    texts = docs.select("doc_id", F.col("text").alias("text"), _lang(docs).alias("lang"))
    order = F.xxhash64("doc_id")
    joined = texts.join(sample, "doc_id").select(
        F.pmod(order, F.lit(shards)).cast("bigint").alias("shard"), order.alias("order"), "label", "lang", "text"
    )
    dealt = joined.repartition(shards, "shard").sortWithinPartitions("shard", "order", "label", "text", "lang")
    given = rows = materialise(_word_hashes(dealt), "labelled")
    if max_words:
        running = Window.orderBy("order", "label", "size").rowsBetween(Window.unboundedPreceding, 0)
        fitting = rows.where(F.col("size") <= max_words // LONGEST).withColumn("total", F.sum("size").over(running))
        within = fitting.where(F.col("total") <= max_words).drop("total").repartition(shards, "shard")
        rows = materialise(within.sortWithinPartitions("shard", "order", "label", "size"), "bounded")
    kinds = {
        (r.label, r.calibrates): (r.n, r.words)
        for r in rows.groupBy("label", "calibrates").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
    }
    found = sorted({label for label, _ in kinds})
    if len(found) < 2:
        every = sorted(r.label for r in given.select("label").distinct().collect())
        if len(every) > len(found):
            raise ValueError(f"texts within the bound of {max_words} words have labels {found} of {every}")
        return ToxicityModel(None, 0.0, float(found == [1]), {}, THRESHOLD)
    apart = len(kinds) == 4
    learnt, judged = (rows.where("not calibrates"), rows.where("calibrates")) if apart else (rows, rows)
    of = {x: kinds[x] for x in kinds if not (apart and x[1])}
    count, words = (sum(x) for x in zip(*of.values()))
    rate = sum(n for (label, _), (n, _) in of.items() if label == 1) / count
    net = train(learnt, rate, shards == 1 and count <= BLOCK_ROWS and words <= BLOCK_WORDS)
    margins = materialise(_margins(judged, net), "margins")
    total = sum(n for (_, calibrates), (n, _) in kinds.items() if calibrates or not apart)
    calibrated = _calibrated if total <= collected else _calibrated_by_spark
    return calibrated(net, margins, stands_for)


def _sent(spark: SparkSession, net: Network) -> Broadcast:
    """Plain arrays: a broadcast carries no code."""
    return spark.sparkContext.broadcast([getattr(net, f.name) for f in fields(net)])


def _margins(judged: DataFrame, net: Network) -> DataFrame:
    """``(margin, label, lang)`` of each row."""
    sent = _sent(judged.sparkSession, net)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*sent.value)
        for batch in batches:
            found = [
                net.margins(word_rows(t.view(np.uint64), net.tags), np.array([len(t)]))[0] for t in _lists(batch.column("words"))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.float64()), batch.column("label"), batch.column("lang")], ["margin", "label", "lang"]
            )

    return judged.select("label", "lang", "words").mapInArrow(apply, "margin double, label int, lang string")


def _calibrated(net: Network, judged: DataFrame, stands_for: dict[int, float]) -> ToxicityModel:
    """The model with slope, shift and thresholds from ``judged``, brought to the driver."""
    found = judged.toArrow()
    margins, label = found.column("margin").to_numpy(), found.column("label").to_numpy().astype(np.int64)
    weights = np.where(label == 1, stands_for[1], stands_for[0])
    slope, shift = platt(margins, label, weights)
    model = ToxicityModel(net, slope, shift, {}, THRESHOLD)
    scores = model.probability(margins)
    model.threshold = best_threshold(scores, label, weights)
    langs = np.array(found.column("lang").to_pylist(), object)
    for name in set(langs.tolist()):
        of = np.array([x == name for x in langs])
        if label[of].sum() >= MIN_POSITIVES:
            model.thresholds[name] = best_threshold(scores[of], label[of], weights[of])
    return model


def _calibrated_by_spark(net: Network | None, judged: DataFrame, stands_for: dict[int, float]) -> ToxicityModel:
    """As ``_calibrated``, the sums and the running counts taken by Spark; one row a language comes back."""
    count, ones = judged.agg(F.count("*"), F.sum("label")).first()
    zero, one = _targets(count, ones)
    mean = (stands_for[1] * ones + stands_for[0] * (count - ones)) / count
    of_label = lambda no, yes: F.when(F.col("label") == 1, F.lit(float(yes))).otherwise(F.lit(float(no)))
    times, target, x = of_label(stands_for[0] / mean, stands_for[1] / mean), of_label(zero, one), F.col("margin")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + F.exp(-(x * float(w[0]) + float(w[1]))))
        bend, error = times * p * (1 - p), times * (p - target)
        a, b, c, d, e = judged.agg(*map(F.sum, (bend * x * x, bend * x, bend, error * x, error))).first()
        return np.array([[a, b], [b, c]]), np.array([d, e])

    slope, shift = _newton(sums)
    score = 1 / (1 + F.exp(-F.least(F.greatest(x * slope + shift, F.lit(-50.0)), F.lit(50.0))))
    scored = materialise(judged.select(F.col("lang"), score.alias("probability"), "label"), "judged")
    edges = probability_edges(scored)

    def thresholds(known: Column, least: int) -> dict[str | None, float]:
        group = scored.select(F.struct(known.alias("name")).alias("of"), "probability", "label")
        cells = score_cells(group, ["of"])
        weighed = cells.withColumns({"pos": F.col("pos") * stands_for[1], "neg": F.col("neg") * stands_for[0]})
        hits = F.col("positives") - F.col("pos_below")
        quality = 1.25 * hits / (hits + F.col("negatives") - F.col("neg_below") + 0.25 * F.col("positives"))
        ranked = ranked_cells(weighed, ["of"], edges).where(F.col("positives") > (least - 0.5) * stands_for[1])
        best = ranked.groupBy("of").agg(F.max(F.struct(quality.alias("quality"), "probability"))["probability"].alias("cut"))
        below = cells.join(best, "of").where(F.col("probability") < F.col("cut"))
        after = below.groupBy("of").agg(F.max("probability").alias("after"))
        return {r.name: (r.cut + r.after) / 2 for r in best.join(after, "of", "left").select(
            "of.name", "cut", F.coalesce("after", F.lit(0.0)).alias("after")).collect()}

    everywhere = thresholds(F.lit(None).cast("string"), 1)
    return ToxicityModel(net, slope, shift, thresholds(F.col("lang"), MIN_POSITIVES), everywhere[None])


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def _scored(docs: DataFrame, model: ToxicityModel) -> tuple[Column, Column]:
    """Score and flag of each row of ``docs``. Only the texts go to Python, and only scores come back."""
    score = F.lit(float(model.shift))
    if model.net:
        sent = _sent(docs.sparkSession, model.net)
        slope, shift = model.slope, model.shift

        @F.arrow_udf(DoubleType())
        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            net, model = Network(*sent.value), ToxicityModel(None, slope, shift, {}, THRESHOLD)
            for texts in batches:
                scores = np.empty(len(texts))
                for a, b in kernels.chunks(texts):
                    words = kernels.words_of(texts.slice(a, b - a), lower=True, also=_PUNCTUATION)
                    margins = net.margins(word_rows(words.hashes, net.tags), np.diff(words.first))
                    scores[a:b] = model.probability(margins)
                yield pa.array(scores)

        score = apply(F.col("text"))
    limit = F.lit(float(model.threshold))
    for name, threshold in model.thresholds.items():
        limit = F.when(_lang(docs).eqNullSafe(F.lit(name).cast("string")), F.lit(float(threshold))).otherwise(limit)
    return score, score >= limit


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``flagged`` (score at least the threshold of the language);
    columns of these names are replaced."""
    found, flagged = _scored(docs, model)
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "flagged")]
    return docs.select(*own, found.alias("score"), flagged.alias("flagged"))


def without_flagged(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` below the threshold of their language, with all their columns."""
    return docs.where(~_scored(docs, model)[1])
