"""Sensitive patterns in message bodies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import regex_count

# Patterns of a payment card number and of a social security number.
PATTERNS = {"card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b"}


def dlp_scan(messages: DataFrame, patterns: Mapping[str, str] = PATTERNS, text: Column | None = None) -> DataFrame:
    """``messages`` with dlp_counts (map of pattern name to number of matches) and dlp_hits (names that match, in the order given).

    Scans the body by default. A null text has no matches, an invalid pattern neither.
    """
    text = F.coalesce(F.col("body") if text is None else text, F.lit(""))
    counts = []
    for name, pattern in patterns.items():
        counts += [F.lit(name), regex_count(pattern, text).cast("int")]
    rows = messages.withColumn("dlp_counts", F.create_map(*counts) if counts else F.create_map().cast("map<string,int>"))
    hits = F.filter(F.array(*[F.lit(n) for n in patterns]).cast("array<string>"), lambda n: F.element_at(F.col("dlp_counts"), n) > 0)
    return rows.withColumn("dlp_hits", hits)
