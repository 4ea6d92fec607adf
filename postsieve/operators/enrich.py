"""Lookups of messages in snapshots of DNS, mail hosts, blocklists and filter settings, as equi-joins.

Each snapshot is first brought to one row for each key, so a join never multiplies messages. It is broadcast only when the rows of the table that was given are
counted and few, which is a matter of its footers where it is stored; otherwise Spark joins by a shuffle and may split hot domains. Streams whose snapshots change: see
``streaming.feeds.enriched_stream``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import fresh

#: Rows of a snapshot that may be broadcast; of some hundred bytes each.
BROADCAST_ROWS = 200_000


def _small(snapshot: DataFrame, source: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The snapshot, to be broadcast if the table that it is made of, and that has no fewer rows, is counted to be small; no more than ``most`` + 1 rows are counted."""
    return F.broadcast(snapshot) if source.limit(most + 1).count() <= most else snapshot


def _joined(messages: DataFrame, snapshot: DataFrame, source: DataFrame, key: str, to: str, added: dict[str, Callable[[Callable[[str], Column]], Column]]) -> DataFrame:
    """``messages`` with the added columns; those of the same names are replaced, all others stay, whatever their names.

    ``added`` speaks of the columns of the snapshot, with its key as _to; here they are the fields of one struct."""
    key_, found_ = fresh(messages.columns, "key_", "found_")
    right = _small(snapshot, source).withColumnRenamed(to, "_to")
    right = right.select(F.col("_to").alias(key_), F.struct(*right.columns).alias(found_))
    out = messages.join(right, messages[key] == right[key_], "left")
    made = {name: make(lambda c: F.col(f"{found_}.{c}")) for name, make in added.items()}
    kept = [F.col(f"`{c}`") for c in messages.columns if c not in made]
    return out.select(*kept, *[c.alias(name) for name, c in made.items()])


def enrich_dns(messages: DataFrame, dns: DataFrame) -> DataFrame:
    """dns_resolved and sender_ip (empty without one), from ``dns`` (domain, ip); of several addresses of a domain the smallest."""
    one = dns.groupBy("domain").agg(F.min("ip").alias("_ip"))
    return _joined(messages, one, dns, "sender_domain", "domain", {"dns_resolved": lambda c: c("_to").isNotNull(), "sender_ip": lambda c: F.coalesce(c("_ip"), F.lit(""))})


def mx_by_domain(mx: DataFrame) -> DataFrame:
    """(domain, _hosts, _v4, _v6) from ``mx`` (domain, pref, host, ip): hosts by preference and name. A domain has few of them."""
    hosts = F.transform(F.sort_array(F.collect_set(F.struct("pref", "host"))), lambda x: x["host"])
    six = F.contains("ip", F.lit(":"))
    return mx.groupBy("domain").agg(hosts.alias("_hosts"), F.coalesce(F.bool_or(~six), F.lit(False)).alias("_v4"), F.coalesce(F.bool_or(six), F.lit(False)).alias("_v6"))


def enrich_mx(messages: DataFrame, mx: DataFrame) -> DataFrame:
    """mx_records (array of hosts by preference) and valid_mx."""
    hosts = lambda c: F.coalesce(c("_hosts"), F.array().cast("array<string>"))
    return _joined(messages, mx_by_domain(mx).select("domain", "_hosts"), mx, "sender_domain", "domain", {"mx_records": hosts, "valid_mx": lambda c: F.size(hosts(c)) > 0})


def enrich_mx_family(messages: DataFrame, mx: DataFrame) -> DataFrame:
    """is_mx_ipv4 and is_mx_ipv6: whether a mail host of the domain has an address of the family."""
    flags = {"is_mx_ipv4": lambda c: F.coalesce(c("_v4"), F.lit(False)), "is_mx_ipv6": lambda c: F.coalesce(c("_v6"), F.lit(False))}
    return _joined(messages, mx_by_domain(mx).select("domain", "_v4", "_v6"), mx, "sender_domain", "domain", flags)


def _listed(rbl: DataFrame, zone: str | None) -> DataFrame:
    return (rbl.where(F.col("zone") == zone) if zone else rbl).groupBy("ip").agg(F.min("zone").alias("_zone"))


def enrich_rbl(messages: DataFrame, rbl: DataFrame, zone: str | None = None) -> DataFrame:
    """rbl_listed and rbl_name (the first zone by name; empty if not listed), for sender_ip in ``rbl`` (ip, zone), of one zone or all."""
    return _joined(messages, _listed(rbl, zone), rbl, "sender_ip", "ip", {"rbl_listed": lambda c: c("_to").isNotNull(), "rbl_name": lambda c: F.coalesce(c("_zone"), F.lit(""))})


def only_listed(messages: DataFrame, rbl: DataFrame, zone: str | None = None) -> DataFrame:
    """The messages whose sender_ip is listed."""
    return messages.join(_small(_listed(rbl, zone).select(F.col("ip").alias("sender_ip")), rbl), "sender_ip", "left_semi")


def only_clean(messages: DataFrame, rbl: DataFrame, zone: str | None = None) -> DataFrame:
    """The messages whose sender_ip is not listed."""
    return messages.join(_small(_listed(rbl, zone).select(F.col("ip").alias("sender_ip")), rbl), "sender_ip", "left_anti")


def enrich_mx_rbl(messages: DataFrame, mx: DataFrame, rbl: DataFrame, zone: str | None = None) -> DataFrame:
    """mx_in_rbl: whether an address of a mail host of the domain is listed."""
    domains = mx.join(_small(_listed(rbl, zone), rbl), "ip", "left_semi").select("domain").distinct()
    return _joined(messages, domains, mx, "sender_domain", "domain", {"mx_in_rbl": lambda c: c("_to").isNotNull()})


def resolve_domain(messages: DataFrame, dns: DataFrame, mx: DataFrame | None = None, verify: bool = False) -> DataFrame:
    """domain_resolves: the sender's domain is in ``dns``; with ``verify`` it must have a mail host too."""
    rows = enrich_dns(messages, dns)
    good = F.col("dns_resolved")
    if verify:
        if mx is None:
            raise ValueError("verify needs mx")
        rows = enrich_mx(rows, mx)
        good = good & F.col("valid_mx")
    return rows.withColumn("domain_resolves", good)


def attach_config(messages: DataFrame, config: DataFrame) -> DataFrame:
    """instance_name, content_filter, content_filter_name and content_filter_rules (map), by instance, from ``config`` (instance,
    instance_name, content_filter, content_filter_name, rule, value), one row for each rule; of a rule's values the largest counts."""
    one = config.groupBy("instance", "rule").agg(*[F.max(c).alias(c) for c in ("instance_name", "content_filter", "content_filter_name", "value")])
    names = {c: F.max(c).alias(f"_{c}") for c in ("instance_name", "content_filter", "content_filter_name")}
    pairs = F.sort_array(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "value"))))
    by_instance = one.groupBy("instance").agg(*names.values(), F.map_from_entries(pairs).alias("_rules"))
    added = {n: lambda c, n=n: F.coalesce(c(f"_{n}"), F.lit("")) for n in names} | {"content_filter_rules": lambda c: F.coalesce(c("_rules"), F.create_map().cast("map<string,string>"))}
    return _joined(messages, by_instance, config, "instance", "instance", added)
