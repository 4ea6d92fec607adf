"""Raw messages to message columns, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import sender_domain
from ..schema import fresh, text_or_empty

_ENTRIES = "array<struct<k:string,v:string>>"
#: The headers with the first blank line. A split with a limit would go on to look for blank lines through the whole body.
_HEAD = r"(?s)^.*?(?:^|\r?\n)\r?\n"


def canonical_key(key: Column) -> Column:
    """message-id becomes Message-Id; a key with characters that header names may not have stays as it is."""
    parts = F.transform(F.split(F.lower(key), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.when(key.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"), F.array_join(parts, "-")).otherwise(key)


def header_entries(block: Column, canonical: bool) -> Column:
    """All headers of a block in order, as (k, v), with continuation lines joined to the line before."""
    lines = F.split(F.regexp_replace(block, r"\r?\n[ \t]+", " "), r"\r?\n")
    lines = F.filter(lines, lambda x: F.contains(x, F.lit(":")))

    def entry(line: Column) -> Column:
        key = F.substring_index(line, ":", 1)
        value = F.trim(F.substr(line, F.length(key) + 2), F.lit(" \t\r\n"))
        key = F.trim(key, F.lit(" \t\r\n"))
        return F.struct((canonical_key(key) if canonical else key).alias("k"), value.alias("v"))

    return F.transform(lines, entry)


def headers_map(entries: Column, last: bool) -> Column:
    """One value for each key: the first or the last one."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    place = -1 if last else 1
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), place)["v"]))


def values_of(entries: Column, name: str) -> Column:
    return F.transform(F.filter(entries, lambda e: e["k"] == F.lit(name)), lambda e: e["v"])


def parse_messages(raw: DataFrame, header_mode: str = "first", raw_col: str = "raw", domain_mode: str = "raw") -> DataFrame:
    """``raw`` with headers, header_block, body, entries, received_headers, mime_type, sender, subject, sender_domain and error; the raw column goes.

    header_mode "first" is the mailbox path: keys are canonical, the first value of a key wins, and a header line without a colon, or a message without any header and
    blank line, is a parse error that leaves the rest empty. "last" is the gateway path: keys as written, the last value wins, and lines without a colon
    are passed over. The body is what follows the first blank line, undecoded. A null message is an empty one.
    An error that a row already has stays.
    """
    if header_mode not in ("first", "last"):
        raise ValueError(f"unknown header_mode {header_mode!r}")
    first = header_mode == "first"
    had_error = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    text_, head_, blank_ = fresh([*raw.columns, "header_block", "body", "entries"], "text_", "head_", "blank_")
    text = text_or_empty(F.col(raw_col))
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_extract(text, "(?s)^.*", 0))  # bytes that are no text are replaced as everywhere else
    rows = raw.withColumns({"error": had_error, text_: text}).drop(raw_col).withColumn(head_, F.regexp_extract(text_, _HEAD, 0))
    blank = F.col(head_) != ""
    block = F.when(blank, F.regexp_replace(head_, r"(?:^|\r?\n)\r?\n\z", "")).otherwise(F.col(text_))
    body = F.when(blank, F.substr(text_, F.length(head_) + 1)).otherwise(F.lit(""))
    rows = rows.withColumns({"header_block": block, "body": body, blank_: blank}).drop(text_, head_)
    if first:
        lines = F.split(F.regexp_replace("header_block", r"\r?\n[ \t]+", " "), r"\r?\n")
        bad = F.get(F.filter(lines, lambda x: ~x.rlike(r"^[^:\s][^:]*:") & (x != "")), F.lit(0))
        none = (F.trim(F.col("header_block"), F.lit("\r\n")) == "") & ~F.col(blank_)
        problem = F.when(bad.isNotNull(), F.concat(F.lit("parse error: malformed header line: "), bad)).when(none, F.lit("parse error: EOF"))
        rows = rows.withColumn("error", F.coalesce("error", problem))
    good = F.col("error").isNull()
    rows = rows.withColumn("entries", F.when(good, header_entries(F.col("header_block"), first)).otherwise(F.array().cast(_ENTRIES)))
    rows = rows.withColumns({"headers": headers_map(F.col("entries"), not first), "received_headers": values_of(F.col("entries"), "Received"), "body": F.when(good, F.col("body")).otherwise(F.lit(""))})
    header = lambda n: text_or_empty(F.try_element_at(F.col("headers"), F.lit(n)))
    rows = rows.withColumns({"mime_type": header("Content-Type"), "sender": header("From"), "subject": header("Subject")})
    return rows.withColumn("sender_domain", sender_domain(F.col("sender"), domain_mode)).drop(blank_)
