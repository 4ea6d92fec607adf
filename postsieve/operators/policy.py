"""Ordered rules over messages. A policy becomes one projection: arrays of what its rules emit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..schema import fresh, text_or_empty

_NO_TEXTS = "array<string>"
_EDIT = "array<struct<name:string,value:string>>"


def _text(x: str | int | bool | Column) -> Column:
    return text_or_empty(x.cast("string")) if isinstance(x, Column) else F.lit(x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x))


@dataclass(frozen=True)
class Effect:
    """What a rule emits: an action string, and perhaps a log entry or a header edit. Arguments are texts or columns."""

    action: Column
    log: Column | None = None
    header: tuple[Column, Column] | None = None


def _emit(kind: str, *args: str | int | bool | Column) -> Effect:
    parts: list[Column] = [F.lit(kind)]
    for a in args:
        parts += [F.lit(":"), _text(a)]
    return Effect(F.concat(*parts) if args else parts[0])


def accept() -> Effect:
    """Take the message."""
    return _emit("accept")


def discard() -> Effect:
    """Throw the message away."""
    return _emit("discard")


def drop() -> Effect:
    """Drop the message without a word."""
    return _emit("drop")


def bounce() -> Effect:
    """Send the message back."""
    return _emit("bounce")


def quarantine() -> Effect:
    """Hold the message back."""
    return _emit("quarantine")


def fileinto(folder: str | Column) -> Effect:
    """Put the message into a folder."""
    return _emit("fileinto", folder)


def auto_reply(text: str | Column) -> Effect:
    """Answer with a text."""
    return _emit("auto_reply", text)


def divert_to(address: str | Column) -> Effect:
    """Send the message to another address instead."""
    return _emit("divert_to", address)


def screen_to(address: str | Column) -> Effect:
    """Send a copy to an address."""
    return _emit("screen_to", address)


def skip_malware_check(sender: str | Column) -> Effect:
    """No malware check for a sender."""
    return _emit("skip_malware_check", sender)


def skip_spam_check(sender: str | Column) -> Effect:
    """No spam check for a sender."""
    return _emit("skip_spam_check", sender)


def skip_whitelist_check(ip: str | Column) -> Effect:
    """No whitelist check for an address."""
    return _emit("skip_whitelist_check", ip)


def force_second_pass(server: str | Column) -> Effect:
    """Filter the message again, by a server."""
    return _emit("force_second_pass", server)


def set_dlp(mode: str | Column, target: str | Column) -> Effect:
    """Set a mode of data loss prevention for a target."""
    return _emit("set_dlp", mode, target)


def skip_dlp(mode: str | Column, target: str | Column) -> Effect:
    """Leave out a mode of data loss prevention for a target."""
    return _emit("skip_dlp", mode, target)


def add_to_next_digest() -> Effect:
    """List the message in the next digest."""
    return _emit("add_to_digest")


def reply_with_smtp_error(code: int | Column) -> Effect:
    """Answer with an SMTP error code."""
    return _emit("smtp_error", code)


def reply_with_smtp_dsn(dsn: str | Column) -> Effect:
    """Answer with a delivery status."""
    return _emit("smtp_dsn", dsn)


def set_content_filter_rules(rules: str | Column) -> Effect:
    """Set the rules of the content filter."""
    return _emit("set_filter_rules", rules)


def rbl_check(ip: str | Column, server: str | Column) -> Effect:
    """The trace that a blocklist lookup leaves; the lookup itself is the join enrich_rbl."""
    return _emit("rbl_check", ip, server)


def mx_in_rbl(domain: str | Column, server: str | Column) -> Effect:
    """The trace of a lookup of mail hosts in a blocklist; the lookup itself is the join enrich_mx_rbl."""
    return _emit("mx_rbl_check", domain, server)


def domain_resolution(sender: str | Column, verify: bool | Column) -> Effect:
    """The trace of resolving a sender's domain; the lookup itself is resolve_domain."""
    return _emit("domain_resolve", sender, verify)


def log_entry(message: str | Column) -> Effect:
    """A log entry, which is an action too."""
    return Effect(F.concat(F.lit("log:"), _text(message)), log=_text(message))


def add_header(name: str | Column, value: str | Column) -> Effect:
    """A header edit, which is an action too."""
    return Effect(F.concat(F.lit("add_header:"), _text(name), F.lit(":"), _text(value)), header=(_text(name), _text(value)))


@dataclass(frozen=True)
class Vectorised:
    """A condition in Python: ``function`` takes a pandas series for each column and gives one of booleans."""

    function: Callable[..., pd.Series]
    columns: tuple[Column, ...]

    def hits(self, alive: Column) -> Column:
        """Whether the condition holds for rows that are ``alive``; the function sees no others, and false is what they get."""
        function = self.function

        @arrow_udf("boolean")
        def hit(rows: pa.Array) -> pa.Array:
            out = pd.Series(False, index=range(len(rows)))
            there = rows.drop_null()
            if len(there):
                found = function(*[x.to_pandas() for x in there.flatten()])
                out[rows.is_valid().to_numpy(zero_copy_only=False)] = pd.Series(found).fillna(False).to_numpy(bool)
            return pa.array(out.to_numpy(bool))

        named = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(self.columns)])
        return hit(F.when(alive, named))


def vectorised(function: Callable[..., pd.Series], *columns: Column) -> Vectorised:
    """A condition for ``rule`` that Spark functions cannot express. It is worked out only for messages that no earlier rule has stopped; null means that it does not hold."""
    return Vectorised(function, columns)


@dataclass(frozen=True)
class Rule:
    when: Column | Vectorised
    effects: tuple[Effect, ...]
    stop: bool = False


def rule(when: Column | Vectorised | bool, *effects: Effect, stop: bool = False) -> Rule:
    """A rule: where ``when`` holds (null: it does not) its effects are emitted; with ``stop`` no later rule is looked at then."""
    return Rule(when if isinstance(when, Column | Vectorised) else F.lit(when), effects, stop)


@dataclass(frozen=True)
class Policy:
    """Rules in order. ``default_accept`` adds accept where nothing at all was emitted. ``empty`` rules are allowed."""

    rules: Sequence[Rule] = field(default_factory=tuple)
    default_accept: bool = False


def header_edits(edits: Column) -> Column:
    """Edits (array of name, value) as a map in which the last value of a name stands."""
    names = F.array_distinct(F.transform(edits, lambda e: e["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(edits, lambda e: e["name"] == n), -1)["value"]))


def applied_headers(headers: Column, modified: Column) -> Column:
    """The headers of a message after its edits."""
    return F.map_concat(F.map_filter(headers, lambda k, _: ~F.array_contains(F.map_keys(modified), k)), modified)


def apply_policy(messages: DataFrame, policy: Policy) -> DataFrame:
    """``messages`` with actions, logs (arrays) and modified_headers (map); columns of these names are replaced.

    A message with an error emits nothing. The first stopping rule that holds is found first, by one conditional expression that goes no
    further than that rule, so conditions after it are not worked out; the condition of another rule is looked at only before that
    place. All of it is one projection without a shuffle; a ``vectorised`` condition, which gets only messages that are not stopped before it, makes two of it. Other columns may have any names.
    """
    n = len(policy.rules)
    had_error = F.col("error").isNotNull() if "error" in messages.columns else F.lit(False)
    python = [i for i, r in enumerate(policy.rules) if isinstance(r.when, Vectorised)]
    holds_, stop_, edits_, *hits_ = fresh([*messages.columns, "actions", "logs", "modified_headers"], "holds_", "stop_", "edits_", *[f"hit{i}_" for i in python])
    hit_at, rows = dict(zip(python, hits_, strict=True)), messages
    holds = [F.col(hit_at[i]) if i in hit_at else F.coalesce(r.when, F.lit(False)) for i, r in enumerate(policy.rules)]
    stop = F.when(had_error, -1)
    for i, r in enumerate(policy.rules):
        if i in hit_at:
            # the first stop so far is a column of its own; what comes after starts from it
            rows = rows.withColumn(stop_, stop.otherwise(n))
            rows = rows.withColumn(hit_at[i], r.when.hits(F.col(stop_) == n))
            stop = F.when(F.col(stop_) < n, F.col(stop_))
        stop = stop.when(holds[i], i) if r.stop else stop
    rows = rows.withColumn(stop_, stop.otherwise(n))
    passing = [i for i, r in enumerate(policy.rules) if not r.stop]
    rows = rows.withColumn(holds_, F.array(*[(F.col(stop_) > i) & holds[i] for i in passing]).cast("array<boolean>"))
    fired = {i: F.col(stop_) == i for i in range(n)} | {i: F.col(holds_)[place] for place, i in enumerate(passing)}

    def gathered(kind: str, of) -> Column:
        arrays = [F.when(fired[i], F.array(*found)).otherwise(F.array().cast(kind)) for i, r in enumerate(policy.rules) if (found := [x for e in r.effects if (x := of(e)) is not None])]
        return F.concat(*arrays) if arrays else F.array().cast(kind)

    edit = lambda e: F.struct(e.header[0].alias("name"), e.header[1].alias("value")) if e.header else None
    rows = rows.withColumns({"actions": gathered(_NO_TEXTS, lambda e: e.action), "logs": gathered(_NO_TEXTS, lambda e: e.log), edits_: gathered(_EDIT, edit)})
    if policy.default_accept:
        rows = rows.withColumn("actions", F.when((F.size("actions") == 0) & ~had_error, F.array(F.lit("accept"))).otherwise(F.col("actions")))
    return rows.withColumn("modified_headers", header_edits(F.col(edits_))).drop(holds_, stop_, edits_, *hits_)
