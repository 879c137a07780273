"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of Unicode letters and digits; null for null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_hashes(text: Column) -> Column:
    """64-bit hash of every word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
