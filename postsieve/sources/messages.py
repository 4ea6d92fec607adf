"""Structured rows to the message schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import sender_domain, with_envelope
from ..schema import MESSAGE_FIELDS, default_of, text_or_empty


def from_columns(df: DataFrame, mapping: Mapping[str, Column | str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages from any table or stream: each field from ``mapping`` (a column or its name), else the column of its name, else its
    default. Nulls become defaults. ``keep`` names further columns that stay. The sender comes from the From header and its domain from the sender where neither is given.
    """
    mapping = {k: F.col(v) if isinstance(v, str) else v for k, v in (mapping or {}).items()}
    unknown = set(mapping) - {name for name, _, _ in MESSAGE_FIELDS}
    if unknown:
        raise ValueError(f"no such message fields: {sorted(unknown)}")
    given = {name: mapping.get(name, F.col(name) if name in df.columns else None) for name, _, _ in MESSAGE_FIELDS}
    if given["sender"] is None and given["headers"] is not None:
        given["sender"] = text_or_empty(F.try_element_at(given["headers"], F.lit("From")))
    if given["sender_domain"] is None and given["sender"] is not None:
        given["sender_domain"] = sender_domain(given["sender"])
    columns = []
    for name, kind, value in MESSAGE_FIELDS:
        own = given[name]
        default = default_of(kind, value)
        columns.append((default if own is None else own.cast(kind) if value is None else F.coalesce(own.cast(kind), default)).alias(name))
    return df.select(*columns, *[F.col(k) for k in keep])


def from_requests(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages from requests (from, to, headers, body, forward_to_upstream). Envelope headers are added; the domain is that of the envelope sender."""
    sender = text_or_empty(F.col("`from`"))
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    mapping = {
        "headers": with_envelope(headers, sender, F.col("to")),
        "mime_type": F.try_element_at(headers, F.lit("Content-Type")),
        "sender": sender,
        "sender_domain": sender_domain(sender),
        "envelope_senders": F.array(sender),
    }
    return from_columns(requests.withColumnRenamed("from", "_from").withColumn("from", F.col("_from")), mapping, keep)
