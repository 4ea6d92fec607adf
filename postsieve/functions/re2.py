"""Patterns that are run by RE2 itself, on Arrow batches: linear in the length of a text, whatever the pattern."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def is_valid(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def matches(pattern: str) -> Callable[[Column], Column]:
    """Whether the pattern matches somewhere in a text; null for null."""

    @arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        return pc.match_substring_regex(text, pattern)

    return hit


def counts(pattern: str) -> Callable[[Column], Column]:
    """The number of matches in a text, not overlapping; null for null."""

    @arrow_udf("int")
    def number(text: pa.Array) -> pa.Array:
        return pc.count_substring_regex(text, pattern).cast(pa.int32())

    return number
