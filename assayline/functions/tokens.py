"""Column functions that turn text into tokens, n-grams and in-row term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import WHITESPACE_CLASS, strip_accents

# Fixed value: lower-case ASCII alphanumerics with at most one inner apostrophe.
TOKEN_PATTERN = "[a-z0-9]+(?:['’][a-z0-9]+)?"
# Fixed value: runs of at least two word characters (letters, numbers, underscore).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

PAD_ID = 0
UNKNOWN_ID = 1
RESERVED_IDS = 2


def regex_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def with_word_ngrams(df: DataFrame, text: str, out: str, low: int = 1, high: int = 1) -> DataFrame:
    """Add all n-grams of words for n in [low, high], repeats kept, joined by one space.

    Words are a column of their own, so they are cut out once however often they are used.
    """
    df = _with_folded(df, text).withColumn(
        "_words", F.regexp_extract_all("_folded", F.lit(WORD_PATTERN), F.lit(0))
    )
    parts, gram = [], F.col("_words")
    for n in range(1, high + 1):
        if n > 1:
            count = F.greatest(F.size("_words") - F.lit(n - 1), F.lit(0))
            gram = F.zip_with(
                F.slice(gram, F.lit(1), count),
                F.slice("_words", F.lit(n), count),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        if n >= low:
            parts.append(gram)
    terms = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.withColumn(out, terms).drop("_folded", "_words")


def with_char_ngrams(df: DataFrame, text: str, out: str, low: int = 3, high: int = 5) -> DataFrame:
    """Add character n-grams inside words, each word padded with one space on both sides.

    With padding shared out as double spaces, a gram of width n is a fixed shape over
    "space / non-space", so one look-ahead per n lists all (overlapping) grams natively.
    The character consumed after the look-ahead keeps surrogate pairs whole.
    A padded word shorter than n yields nothing for that n, one of width n yields itself.
    """
    if low < 3:
        raise ValueError("widths below 3 would have to cut into the padding")
    padded = F.concat(
        F.lit(" "), F.regexp_replace("_folded", f"[{WHITESPACE_CLASS}]+", "  "), F.lit(" ")
    )
    df = _with_folded(df, text).withColumn("_padded", padded)
    grams = []
    for n in range(low, high + 1):
        shapes = f" [^ ]{{{n - 1}}}|[^ ]{{{n}}}|[^ ]{{{n - 1}}} | [^ ]{{{n - 2}}} "
        grams.append(F.regexp_extract_all("_padded", F.lit(f"(?s)(?=({shapes}))."), F.lit(1)))
    terms = grams[0] if len(grams) == 1 else F.concat(*grams)
    return df.withColumn(out, terms).drop("_folded", "_padded")


def with_folded_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the runs of other than white space that ``with_char_ngrams`` pads; empty ones at the ends may come with them."""
    return _with_folded(df, text).withColumn(out, F.split("_folded", f"[{WHITESPACE_CLASS}]+")).drop("_folded")


def with_term_counts(df: DataFrame, terms: str, out: str) -> DataFrame:
    """Add ``array<struct<term, tf>>`` of an array column, inside the row, with no shuffle.

    Sorting puts equal terms side by side; the gap between starts of runs is the count.
    Lambdas see their own arguments only: a column used inside one could be inlined into it
    and be computed again for every element.
    """
    return (
        df.withColumn("_sorted", F.sort_array(terms))
        .withColumn(
            "_starts",
            F.expr(
                "filter(transform(zip_with(_sorted, concat(array(cast(null as string)), "
                "slice(_sorted, 1, greatest(size(_sorted) - 1, 0))), "
                "(t, p) -> if(p is null or t <> p, t, null)), "
                "(t, i) -> struct(t as term, i as at)), x -> x.term is not null)"
            ),
        )
        .withColumn(
            out,
            F.expr(
                "filter(zip_with(_starts, concat(slice(_starts, 2, greatest(size(_starts) - 1, "
                "0)), array(struct(cast(null as string) as term, size(_sorted) as at))), "
                "(s, n) -> struct(s.term as term, n.at - s.at as tf)), x -> x.term is not null)"
            ),
        )
        .drop("_sorted", "_starts")
    )


def _with_folded(df: DataFrame, text: str) -> DataFrame:
    """Lower case, then accents off: the input of word and character n-grams."""
    return df.withColumn("_lower", F.lower(text)).withColumn(
        "_folded", strip_accents(F.col("_lower"))
    ).drop("_lower")


def pad_tokens(ids: Column, width: int) -> Column:
    """Exactly ``width`` ids: cut when longer, filled with the padding id when shorter."""
    kept = F.slice(ids, 1, width)
    return F.concat(
        kept, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(width) - F.size(kept), F.lit(0)))
    )
