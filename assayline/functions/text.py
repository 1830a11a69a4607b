"""Column functions over text: duplicate key, stable id, accents, lengths, blank tests."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split() and str.strip() treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a regex class; ranges keep the per-character test short.
WHITESPACE_CLASS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
_ASCII_WHITESPACE_CLASS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
# Of those, the ones NFKC leaves in place; it turns all others into plain spaces.
_WHITESPACE_AFTER_NFKC = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u1680\u2028\u2029"

_NORMALIZER = "com.ibm.icu.text.Normalizer"
_CHARACTERS = "com.ibm.icu.lang.UCharacter"


def _static(class_name: str, method: str, text: Column) -> Column:
    """Call a static ``(String, boolean)`` method of the ICU library Spark itself ships with.

    It does not accept null; callers guard the column they start from.
    """
    return F.java_method(F.lit(class_name), F.lit(method), text, F.lit(True))


def _nfkc(text: Column) -> Column:
    return _static(_NORMALIZER, "compose", text)


def _nfkd(text: Column) -> Column:
    return _static(_NORMALIZER, "decompose", text)


def _casefold(text: Column) -> Column:
    return _static(_CHARACTERS, "foldCase", text)


def text_key(text: Column) -> Column:
    """NFKC, full case folding, every whitespace run to one space, ends trimmed.

    Used only to find duplicates and leaks, never as model input.
    """
    folded = F.when(text.isNotNull(), _casefold(_nfkc(text)))
    return F.trim(F.regexp_replace(folded, f"[{_WHITESPACE_AFTER_NFKC}]+", " "))


def stable_id(key: Column) -> Column:
    return F.concat(F.lit("sentence_"), F.sha2(key, 256))


def key_digest(key: Column) -> Column:
    """32 bytes standing for a key of any length, so shuffles never carry the key text."""
    return F.unhex(F.sha2(key, 256))


def strip(text: Column) -> Column:
    """Drop whitespace at both ends, Unicode-wide (``trim`` drops only plain spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WHITESPACE_CLASS}]")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _combining_class() -> str:
    """Regex class of all code points with a non-zero combining class, as ranges."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    ranges: list[list[int]] = []
    for mark in marks:
        if ranges and mark == ranges[-1][1] + 1:
            ranges[-1][1] = mark
        else:
            ranges.append([mark, mark])
    body = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)
    # \p{M} first: it is one cheap lookup and false for almost every character.
    return f"[\\p{{M}}&&[{body}]]"


_COMBINING = _combining_class()


def strip_accents(text: Column) -> Column:
    """NFKD, then drop combining marks. Plain ASCII is returned as it is."""
    plain = F.when(is_ascii(text), text)
    return plain.when(text.isNotNull(), F.regexp_replace(_nfkd(text), _COMBINING, ""))


def count_words(text: Column) -> Column:
    """Whitespace-separated words; ASCII text takes the cheaper class."""
    return F.when(
        is_ascii(text), F.regexp_count(text, F.lit(f"[^{_ASCII_WHITESPACE_CLASS}]+"))
    ).otherwise(F.regexp_count(text, F.lit(f"[^{WHITESPACE_CLASS}]+")))
