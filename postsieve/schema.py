"""Column names, types and defaults of messages, requests, inbox rows and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text, _flag, _whole = T.StringType(), T.BooleanType(), T.LongType()
_texts, _map = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())

#: Field, type and default value of a message, in order.
MESSAGE_FIELDS: list[tuple[str, T.DataType, object]] = [
    ("message_num", _whole, None),
    ("headers", _map, {}),
    ("header_block", _text, ""),
    ("body", _text, ""),
    ("mime_type", _text, ""),
    ("spam_score", T.DoubleType(), 0.0),
    ("virus_status", _text, "clean"),
    ("sender_did", _text, ""),
    ("envelope_senders", _texts, []),
    ("content_filter", _text, ""),
    ("content_filter_name", _text, ""),
    ("content_filter_rules", _map, {}),
    ("instance", _text, ""),
    ("instance_name", _text, ""),
    ("sender", _text, ""),
    ("sender_domain", _text, ""),
    ("sender_ip", _text, ""),
    ("dns_resolved", _flag, True),
    ("mx_records", _texts, []),
    ("rbl_listed", _flag, False),
    ("rbl_name", _text, ""),
    ("received_headers", _texts, []),
    ("error", _text, None),
]

REQUEST = T.StructType(
    [T.StructField("from", _text), T.StructField("to", _texts), T.StructField("headers", _map), T.StructField("body", _text), T.StructField("forward_to_upstream", _flag)]
)

INBOX = T.StructType(
    [T.StructField(n, _text) for n in ("sender", "subject", "raw_headers", "body_plain", "body_html")] + [T.StructField("spam_score", T.DoubleType())]
)

RESULT = T.StructType(
    [
        T.StructField("message_num", _whole), T.StructField("from", _text), T.StructField("subject", _text), T.StructField("actions", _texts),
        T.StructField("logs", _texts), T.StructField("modified_headers", _map), T.StructField("error", _text),
    ]
)


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, with underscores before those that a column already has (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def default_of(kind: T.DataType, value: object) -> Column:
    """A literal of the type: empty maps and arrays, or the value."""
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(value).cast(kind)
