"""Scoring rows as they arrive. Scoring keeps no state, so the batch operator serves a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import is_blank
from assayline.operators.learn import Rung
from assayline.operators.score import decide
from assayline.schema import ID, TEXT


def score_stream(rows: DataFrame, rung: Rung) -> DataFrame:
    """Scored output of a stream of ``(sentence_id, text)``; blank text or a missing id fails.

    Uniqueness of ids is a property of a whole table and is left to the batch check.
    """
    bad = F.col(ID).isNull() | F.col(TEXT).isNull() | is_blank(F.col(TEXT))
    text = F.when(bad, F.raise_error(F.lit("row without id or text"))).otherwise(F.col(TEXT))
    return decide(rung.score(rows.select(ID, text.alias(TEXT))), rung.name)
