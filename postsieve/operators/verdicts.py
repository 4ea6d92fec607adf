"""Verdicts, routing and dispositions, from the actions of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reason that each rejecting action gives, and how a folder of spam begins.
REASONS = {"discard": "Message discarded by filter", "quarantine": "Message quarantined", "bounce": "Message bounced", "drop": "Message dropped"}
SPAM_FOLDER, SPAM_REASON = "fileinto:Spam", "Classified as spam"

# The kinds of actions.
KINDS = (
    "accept", "discard", "drop", "bounce", "quarantine", "fileinto", "auto_reply", "divert_to", "screen_to", "skip_malware_check", "skip_spam_check", "skip_whitelist_check",
    "force_second_pass", "set_dlp", "skip_dlp", "add_to_digest", "smtp_error", "smtp_dsn", "set_filter_rules", "rbl_check", "mx_rbl_check", "domain_resolve", "log", "add_header",
)

#: Actions with more than one argument, which may hold colons themselves only in the last one.
_TWO_ARGUMENTS = ("add_header", "set_dlp", "skip_dlp", "mx_rbl_check", "domain_resolve")
_TERMINAL = ("discard", "drop", "bounce", "quarantine")


def is_rejecting(action: Column) -> Column:
    return action.isin(*REASONS) | F.startswith(action, F.lit(SPAM_FOLDER))


def reason_of(action: Column) -> Column:
    out = F.when(F.startswith(action, F.lit(SPAM_FOLDER)), SPAM_REASON)
    for name, reason in REASONS.items():
        out = out.when(action == name, reason)
    return out


def verdict(results: DataFrame, mode: str = "first") -> DataFrame:
    """``results`` with accepted and reason.

    mode "first" is the gateway: the first rejecting action decides; an accepted message has an empty reason, one with an error is
    rejected with a fixed reason. "last" is the RPC path: the last rejecting action gives the reason, an accepted message is told so, and an error is quoted.
    """
    if mode not in ("first", "last"):
        raise ValueError(f"unknown mode {mode!r}")
    first = mode == "first"
    rejecting = F.filter("actions", is_rejecting)
    chosen = F.get(rejecting, F.lit(0) if first else F.size(rejecting) - 1)
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    failed = F.lit("Script execution error") if first else F.concat(F.lit("Script error: "), error)
    reason = F.when(error.isNotNull(), failed).otherwise(F.coalesce(reason_of(chosen), F.lit("" if first else "Message accepted")))
    return results.withColumns({"accepted": error.isNull() & chosen.isNull(), "reason": reason})


def route_actions(results: DataFrame, keys: tuple[str, ...] = ("message_num",)) -> DataFrame:
    """One row for each action: keys, pos (0-based), kind, arg1, arg2. Values keep their colons; absent arguments are null.

    This is what consumers of one kind of action read: filter by kind. A blocklist trace has an address, which may be IPv6, before its
    server: its first argument ends at the last colon.
    """
    rows = results.select(*keys, F.posexplode("actions").alias("pos", "action"))
    kind = F.substring_index("action", ":", 1)
    rest = F.when(F.contains("action", F.lit(":")), F.substr("action", F.length(kind) + 2))
    two = F.split(rest, ":", 2)
    last_colon = F.length(rest) - F.length(F.substring_index(rest, ":", -1))
    first = F.when(kind.isin(*_TWO_ARGUMENTS), F.get(two, F.lit(0))).when((kind == "rbl_check") & F.contains(rest, F.lit(":")), F.substr(rest, F.lit(1), last_colon - 1)).otherwise(rest)
    second = F.when(kind.isin(*_TWO_ARGUMENTS), F.get(two, F.lit(1))).when((kind == "rbl_check") & F.contains(rest, F.lit(":")), F.substring_index(rest, ":", -1))
    return rows.select(*keys, "pos", kind.alias("kind"), first.alias("arg1"), second.alias("arg2"))


def disposition(results: DataFrame) -> DataFrame:
    """``results`` with disposition: the folder of the first fileinto or the first terminal action, whichever comes first; else inbox."""
    ends = F.filter("actions", lambda a: F.startswith(a, F.lit("fileinto:")) | a.isin(*_TERMINAL))
    first = F.get(ends, F.lit(0))
    folder = F.when(F.startswith(first, F.lit("fileinto:")), F.substr(first, F.lit(len("fileinto:") + 1))).otherwise(first)
    return results.withColumn("disposition", F.coalesce(folder, F.lit("inbox")))
