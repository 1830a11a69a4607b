"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space [\x20\x09-\x0D] that separates words and pads lines.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body (and the
    lambdas inside it) refer to it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged; pure ASCII takes the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_digest(text: Column) -> Column:
    """Tells rows that share an id apart; null differs from the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def same_row(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of all ``columns`` of two aliased sides of a join."""
    condition = F.lit(True)
    for name in columns:
        condition &= F.col(f"{left}.`{name}`").eqNullSafe(F.col(f"{right}.`{name}`"))
    return condition


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def salted(df: DataFrame, salts: int, name: str = "salt") -> DataFrame:
    """Every row once for each salt, to meet the other side of a join in as many parts."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on columns of the same names; the keys come from the left side."""
    names = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for mine, other in names.items():
        condition &= F.col(mine).eqNullSafe(F.col(other))
    return left.join(renamed, condition, how).drop(*names.values())
