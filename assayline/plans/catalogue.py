"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayline.plans import data_queries, learning_queries, metric_queries, text_queries

_PARTS = (data_queries, text_queries, metric_queries, learning_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


# DuckDB widens some integers (sums, lengths, row numbers); these columns go back to the
# type the DataFrame has.
_TYPES = {
    "scan_labelled_lines": {"positives": "bigint"},
    "union_sources": {"characters": "int"},
    "archive_members": {"characters": "bigint"},
    "dataset_summary": {"missing_cells": "bigint"},
    "text_lengths": {"characters": "int", "words": "int"},
    "vocabulary": {"token_id": "int"},
    "word_ngrams": {"tf": "int"},
    "prediction_alignment": {"predicted": "bigint"},
    "select_candidate": {"candidate_index": "int"},
    "early_stopping": {"best_epoch": "int", "last_epoch": "int", "epoch": "int"},
    "cost_columns": {"artifact_bytes": "bigint"},
}


def _typed(name: str, query: str) -> str:
    if name not in _TYPES:
        return query
    casts = ", ".join(f"cast({c} as {t}) as {c}" for c, t in _TYPES[name].items())
    return f"select * replace ({casts}) from ({query})"


def oracles() -> dict[str, str]:
    found = {name: query for part in _PARTS for name, query in part.ORACLES.items()}
    return {name: _typed(name, query) for name, query in found.items()}
