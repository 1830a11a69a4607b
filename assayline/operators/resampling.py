"""Intervals of any metric of (label, probability) by a Poisson bootstrap over cells.

Rows of one probability are one cell with counts of both labels. A resample gives every row a Poisson(1)
weight, so a cell's counts become Poisson draws of its own counts, fixed by seed and cell and the
same wherever and however often they are drawn. Rows are read once, to count the cells.

Ranking metrics need running sums along the probabilities: cells are dealt out by ranges, the ranges' sums
(one array over all resamples) are shifted by those of the ranges below, and each range then adds up its
parts. Nothing is ordered as a whole, and what leaves a range has one length for any data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.probability import calibration_bin, true_class_loss
from assayline.operators.metrics import probability_edges, score_cells
from assayline.session import materialise

#: What a row of label 1 and one of label 0 adds to a mean, from its probability.
MeanMetric = Callable[[Column], tuple[Column, Column]]
MEANS: dict[str, MeanMetric] = {
    "brier_score": lambda p: ((1 - p) * (1 - p), p * p),
    "log_loss": lambda p: true_class_loss(p, 1 - p),
}
BINS = 10
#: Numbers drawn at once in a task.
CHUNK_DRAWS = 1 << 21


def _draws(cells: pa.Table, seed: int, iterations: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (first, last, pos, neg) of a group's cells in order; column 0 holds the counts themselves,
    the others one resample each."""
    keys, pos, neg = (cells.column(c).to_numpy() for c in ("key", "pos", "neg"))
    step = max(1, CHUNK_DRAWS // (iterations + 1))
    for a in range(0, len(keys), step):
        b = min(a + step, len(keys))
        drawn = np.empty((2, b - a, iterations + 1))
        drawn[0, :, 0], drawn[1, :, 0] = pos[a:b], neg[a:b]
        for at in range(a, b):
            random = np.random.default_rng([seed, int(keys[at]) & (1 << 64) - 1])
            drawn[0, at - a, 1:] = random.poisson(pos[at], iterations)
            drawn[1, at - a, 1:] = random.poisson(neg[at], iterations)
        yield a, b, drawn[0], drawn[1]


def _row(cells: pa.Table, values: dict[str, np.ndarray]) -> pa.Table:
    """The group's own columns with one array per name."""
    arrays = {n: pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for n, v in values.items()}
    return pa.table({c: cells.column(c).slice(0, 1) for c in cells.column_names if c.startswith("by_")} | {
        "range": cells.column("range").slice(0, 1)} | arrays)


def _range_totals(seed: int, iterations: int):
    def total(cells: pa.Table) -> pa.Table:
        sums = np.zeros((2, iterations + 1))
        for _, _, pos, neg in _draws(cells, seed, iterations):
            sums += pos.sum(0), neg.sum(0)
        return _row(cells, {"p": sums[0], "n": sums[1]})

    return total


def _range_parts(seed: int, iterations: int, means: int):
    def parts(cells: pa.Table, offsets: pa.Table) -> pa.Table:
        below = [np.array(offsets.column(c)[0].as_py()) for c in ("p_below", "n_below")]
        whole = [np.array(offsets.column(c)[0].as_py()) for c in ("p_all", "n_all")]
        cells = cells.sort_by("probability")
        values = [(cells.column(f"pos_{i}").to_numpy(), cells.column(f"neg_{i}").to_numpy()) for i in range(means)]
        bins, probability = cells.column("bin").to_numpy(), cells.column("probability").to_numpy()
        found = np.zeros((2 + means, iterations + 1))
        gaps = np.zeros((BINS, iterations + 1))
        for a, b, pos, neg in _draws(cells, seed, iterations):
            p_below, n_below = (x + np.cumsum(c, axis=0) - c for x, c in zip(below, (pos, neg)))
            found[0] += (pos * (n_below + neg / 2)).sum(0)
            hits, misses = whole[0] - p_below, whole[1] - n_below
            with np.errstate(invalid="ignore", divide="ignore"):
                found[1] += np.nan_to_num(pos * (hits / (hits + misses))).sum(0)
            for i, (one, zero) in enumerate(values):
                found[2 + i] += one[a:b] @ pos + zero[a:b] @ neg
            np.add.at(gaps, bins[a:b], probability[a:b, None] * (pos + neg) - pos)
            below = [x + c.sum(0) for x, c in zip(below, (pos, neg))]
        return _row(cells, {"sums": found, "gaps": gaps})

    return parts


def _metrics(names: list[str], iterations: int):
    def finish(ranges: pa.Table) -> pa.Table:
        first = ranges.slice(0, 1)
        positives, negatives = (np.array(first.column(c)[0].as_py()) for c in ("p_all", "n_all"))
        sums = sum(np.array(x.as_py()) for x in ranges.column("sums")).reshape(-1, iterations + 1)
        gaps = sum(np.array(x.as_py()) for x in ranges.column("gaps")).reshape(BINS, -1)
        rows = positives + negatives
        with np.errstate(invalid="ignore", divide="ignore"):
            values = [sums[0] / (positives * negatives), sums[1] / positives]
            values += [s / rows for s in sums[2:]] + [np.abs(gaps).sum(0) / rows]
        both = (positives > 0) & (negatives > 0)
        count = len(names) * (iterations + 1)
        own = {c: pa.concat_arrays([first.column(c).combine_chunks()] * count) for c in first.column_names if c.startswith("by_")}
        return pa.table(own | {
            "metric": pa.array(np.repeat(names, iterations + 1)),
            "iteration": pa.array(np.tile(np.arange(iterations + 1), len(names))),
            "value": pa.array(np.concatenate([np.where(both, v, np.nan) for v in values]), from_pandas=True),
        })

    return finish


def probability_intervals(
    scored: DataFrame,
    by: list[str],
    means: dict[str, MeanMetric] | None = None,
    iterations: int = 1_000,
    seed: int = 42,
    edges: list[float] | None = None,
) -> DataFrame:
    """``(by, metric, point, used_iterations, ci_low, ci_high)`` of ROC AUC, average precision, expected
    calibration error and any means over the rows (Brier score and log loss, unless given).

    Resamples that lost one class are skipped; a group without both classes has no row.
    """
    means = MEANS if means is None else means
    edges = probability_edges(scored) if edges is None else edges
    names = {c: f"by_{c}" for c in by}
    group = list(names.values())
    cells = score_cells(scored, by).withColumnsRenamed(names)
    p = F.col("probability")
    pairs = {f"{label}_{i}": value for i, f in enumerate(means.values()) for label, value in zip(("pos", "neg"), f(p))}
    cells = cells.withColumns({
        "key": F.xxhash64(*group, "probability"), "bin": calibration_bin(p, BINS).cast("int"),
        **{n: v.cast("double") for n, v in pairs.items()},
    })
    splits = [float("-inf"), *edges, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="probability", outputCol="range").transform(cells) if edges else cells.withColumn("range", F.lit(0.0))
    ranged = materialise(ranged, "cells")
    own = ", ".join(f"`{c}` {t}" for c, t in ranged.select(*group).dtypes)
    lists = "array<double>"
    whole = ", ".join([*([own] if group else []), "range double"])
    totals = ranged.groupBy(*group, "range").applyInArrow(
        _range_totals(seed, iterations), f"{whole}, p {lists}, n {lists}"
    )
    offsets = _offsets(materialise(totals, "totals"), group, iterations)
    parts = ranged.groupBy(*group, "range").cogroup(offsets.groupBy(*group, "range")).applyInArrow(
        _range_parts(seed, iterations, len(means)), f"{whole}, sums {lists}, gaps {lists}"
    )
    summed = parts.join(offsets.select(*group, "range", "p_all", "n_all"), [*group, "range"])
    columns = ", ".join([*([own] if group else []), "metric string, iteration bigint, value double"])
    every = ["roc_auc", "average_precision", *means, f"ece_{BINS}_bin"]
    values = summed.groupBy(*group).applyInArrow(_metrics(every, iterations), columns)
    drawn = F.col("iteration") > 0
    ends = F.percentile(F.when(drawn, F.col("value")), F.array(F.lit(0.025), F.lit(0.975)))
    found = values.groupBy(*group, "metric").agg(
        F.max(F.when(~drawn, F.col("value"))).alias("point"), F.count(F.when(drawn, F.col("value"))).alias("used_iterations"),
        ends.alias("_ends"),
    )
    return found.where(F.col("point").isNotNull()).withColumns(
        {"ci_low": F.get("_ends", F.lit(0)), "ci_high": F.get("_ends", F.lit(1))}
    ).drop("_ends").withColumnsRenamed({v: k for k, v in names.items()})


def _offsets(totals: DataFrame, group: list[str], iterations: int) -> DataFrame:
    """The ranges' sums below each range and of all ranges; there are as many ranges as edges."""

    def shift(ranges: pa.Table) -> pa.Table:
        ranges = ranges.sort_by("range")
        out = {c: ranges.column(c) for c in (*group, "range")}
        for name in ("p", "n"):
            sums = np.array(ranges.column(name).to_pylist()).reshape(-1, iterations + 1)
            below = np.cumsum(sums, axis=0) - sums
            out[f"{name}_below"] = pa.array(below.tolist(), pa.list_(pa.float64()))
            out[f"{name}_all"] = pa.array([sums.sum(0).tolist()] * len(sums), pa.list_(pa.float64()))
        return pa.table(out)

    own = [f"`{c}` {t}" for c, t in totals.select(*group, "range").dtypes]
    lists = [f"{n}_{w} array<double>" for n in ("p", "n") for w in ("below", "all")]
    return materialise(totals.groupBy(*group).applyInArrow(shift, ", ".join([*own, *lists])), "offsets")
