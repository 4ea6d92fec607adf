"""Message fields as column expressions. A missing value reads as the empty string, never as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import text_or_empty


def get_header(name: str) -> Column:
    """The header with exactly this key, or the empty string."""
    return text_or_empty(F.try_element_at(F.col("headers"), F.lit(name)))


def get_mime_type() -> Column:
    return F.col("mime_type")


def get_spam_score() -> Column:
    return F.col("spam_score")


def get_virus_status() -> Column:
    return F.col("virus_status")


def get_recipient_did() -> Column:
    """The sender's DID: the only one that a message carries."""
    return F.col("sender_did")


def sender_domain(sender: Column, mode: str = "raw") -> Column:
    """What follows the @ of a sender with exactly one @, else the empty string.

    mode "raw" takes the header as it is (``Bob <b@evil.com>`` gives ``evil.com>``); "address" first takes off a display name and <>.
    """
    if mode not in ("raw", "address"):
        raise ValueError(f"unknown mode {mode!r}")
    address = sender
    if mode == "address":
        inner = F.regexp_extract(sender, r"<([^<>]*)>\s*$", 1)
        address = F.trim(F.when(inner != "", inner).otherwise(sender))
    parts = F.split(address, "@")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.lit(""))


def get_sender_domain() -> Column:
    return F.col("sender_domain")


def body_size() -> Column:
    """Bytes of the body."""
    return F.octet_length(F.col("body")).cast("long")


def header_size() -> Column:
    """Bytes of the header block."""
    return F.octet_length(F.col("header_block")).cast("long")


def get_received_headers() -> Column:
    """All Received values, in order."""
    return F.col("received_headers")


def check_received_header(level: int | Column) -> Column:
    """The Received value of this 0-based level; empty when there is none or the level is negative."""
    level = level if isinstance(level, Column) else F.lit(level)
    return F.when(level >= 0, text_or_empty(F.get(F.col("received_headers"), level))).otherwise(F.lit(""))


def num_envelope() -> Column:
    return F.when(F.col("envelope_senders").isNull(), 0).otherwise(F.size("envelope_senders"))


def get_sender_ip() -> Column:
    return F.col("sender_ip")


def received_ip() -> Column:
    """The first IPv4 address in the newest Received header; empty without one."""
    return F.regexp_extract(check_received_header(0), r"(?<![0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9.])", 1)


def get_content_filter() -> Column:
    return F.col("content_filter")


def get_content_filter_name() -> Column:
    return F.col("content_filter_name")


def get_content_filter_rules() -> Column:
    return F.col("content_filter_rules")


def get_instance() -> Column:
    return F.col("instance")


def get_instance_name() -> Column:
    return F.col("instance_name")


def get_rbl_status() -> Column:
    return F.struct(F.col("rbl_listed").alias("listed"), F.col("rbl_name").alias("rbl_name"))


def with_envelope(headers: Column, sender: Column, recipients: Column) -> Column:
    """``headers`` with X-Envelope-From and X-Envelope-To (joined by ", "), whatever they held before."""
    names = ("X-Envelope-From", "X-Envelope-To")
    rest = F.map_filter(headers, lambda k, _: ~k.isin(*names))
    return F.map_concat(rest, F.create_map(F.lit(names[0]), text_or_empty(sender), F.lit(names[1]), text_or_empty(F.array_join(recipients, ", "))))
