"""Conditions of rules. A null operand gives false, as messages have no nulls."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import re2
from .regex import bounded, translate


def contains(text: Column, piece: str | Column) -> Column:
    """Literal, case-sensitive; the empty piece is in every text."""
    return F.coalesce(F.contains(text, piece if isinstance(piece, Column) else F.lit(piece)), F.lit(False))


def body_contains(piece: str | Column) -> Column:
    """The search_body built-in."""
    return contains(F.col("body"), piece)


def _java(pattern: str) -> str | None:
    """The pattern for Java, where that takes a bounded time at each place of a text; None if RE2 has to run it; empty if it is invalid."""
    try:
        java = translate(pattern)
    except NotImplementedError:
        # names of Unicode classes, quoted pieces and swapped greed are for RE2; single bytes are not in the dialect
        java = None
        if re2.is_valid(pattern) and not re.search(r"(?<!\\)(?:\\\\)*\\C", pattern):
            return None
    if java is None or not re2.is_valid(pattern):
        warnings.warn(f"invalid pattern never matches: {pattern!r}", stacklevel=3)
        return ""
    return java if bounded(pattern) else None


def regex_match(pattern: str, text: Column) -> Column:
    """Whether an RE2 pattern matches somewhere in the text, in a time linear in its length. An invalid pattern matches nothing, with a warning when the plan is built.

    Patterns without open-ended repeats stay inside of Spark's code as Java patterns; others are run by RE2 on Arrow batches, as Java could take
    exponential time, or overflow its stack, on long texts.
    """
    java = _java(pattern)
    if java == "":
        return F.lit(False)
    return F.coalesce(text.rlike(java) if java else re2.matches(pattern)(text), F.lit(False))


def regex_count(pattern: str, text: Column) -> Column:
    """How often an RE2 pattern matches in the text, matches not overlapping; 0 for null and for an invalid pattern. As linear as ``regex_match``."""
    java = _java(pattern)
    if java == "":
        return F.lit(0)
    return F.coalesce(F.regexp_count(text, F.lit(java)) if java else re2.counts(pattern)(text), F.lit(0))
