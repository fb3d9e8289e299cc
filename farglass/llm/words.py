"""Word splitting shared by the native operators, as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII characters that are neither digits nor letters (upper case is gone by then).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    For texts that are pure ASCII (as many bytes as characters) ``lower`` is the same and much
    faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def license_words(text: Column) -> Column:
    """Words between ASCII separators, lower-cased; null and separators only give no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def solid_words(text: Column) -> Column:
    """Words between ASCII white space; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def spaced(text: Column) -> Column:
    """`` w0 w1 w2 ``: the words of ``license_words`` each between single spaces."""
    joined = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.concat(F.lit(" "), joined, F.lit(" "))


def count_pieces(text: Column, separators: str) -> Column:
    """Number of non-empty pieces between separators; null gives 0.

    Splitting is about half as dear as collecting matches, which is what ``regexp_count`` does.
    """
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")).cast("long")


def license_word_count(text: Column) -> Column:
    """Size of ``license_words``; upper-case letters need no lowering for a count."""
    return count_pieces(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def solid_word_count(text: Column) -> Column:
    """Size of ``solid_words``."""
    return count_pieces(text, BLANKS)
