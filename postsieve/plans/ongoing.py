"""Registered queries of what runs again and again: linear patterns, tables of rules, limits, streams whose tables change, stored counters, repeated runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, predicates
from ..operators import enrich, policy, rule_table, verdicts
from ..operators.policy import Policy, rule, vectorised
from ..sources import mailbox, sinks
from ..sources.messages import from_columns
from ..sources.tables import saved
from ..streaming import feeds
from . import fixtures, policies
from .fixtures import DNS_SQL, MAIL_SQL, RBL_SQL
from .suite import _READ_SQL, _SPAM_SQL, ORACLES, PHRASES, QUERIES, SUBJECT, TRUSTED, _mail_stream, _read_again, _spam, _written_mbox, query, shown, shown_map, with_tables

__all__ = ["ORACLES", "QUERIES"]  # with those of the suite

# Patterns that backtracking would take very long for, or overflow its stack with.
LINEAR = {
    "alternatives": r"^(?:a|b|[^ab])+\.$", "nested": r"(\w+\s?)+!$", "two_runs": r"\d+[a-z]*\d+x", "wild": r"(?s)the.*and.*of.*!", "optional": "(?:[a-z]?){30}[A-Z]{3}", "word": r"(?i)\b(?:[a-z]+ing\s+)+the\b",
}


@query(with_tables(MAIL_SQL) + "SELECT message_num, " + ", ".join(f"regexp_matches(body, '{p}') AS {name}" for name, p in LINEAR.items()) + ", len(regexp_extract_all(body, '(?:[A-Z][a-z]+ )+')) AS names FROM mail")
def regex_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with open-ended repeats, over whole bodies."""
    body = F.col("body")
    columns = [predicates.regex_match(p, body).alias(name) for name, p in LINEAR.items()]
    return fixtures.messages(spark, sf_dir).select("message_num", *columns, predicates.regex_count("(?:[A-Z][a-z]+ )+", body).cast("long").alias("names"))


_RULE_SQL = r"""cut AS (SELECT item_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: length(w) > 5) AS w FROM benchmark),
rules AS (SELECT item_id * 1000 + i AS rule_no, list_distinct(w[i:i + 1]) AS words, i FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM cut)),
held AS (SELECT message_num, list_distinct(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM mail),
met AS (SELECT message_num, rule_no, count(*) AS n FROM (SELECT message_num, unnest(t) AS word FROM held) JOIN (SELECT rule_no, unnest(words) AS word FROM rules) USING (word) GROUP BY ALL),
best AS (SELECT message_num, min(rule_no) AS rule_no FROM met JOIN (SELECT rule_no, len(words) AS k FROM rules) USING (rule_no) WHERE n = k GROUP BY message_num)
"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each two long words of a benchmark item that follow each other: mail that holds both goes into the item's folder."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    long = F.filter(F.regexp_extract_all(lower, F.lit(rule_table.WORD), 0), lambda w: F.length(w) > 5)
    cut = items.select("item_id", long.alias("w"))
    pairs = cut.select("item_id", F.posexplode(F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("w", i + 1)))).alias("i", "words"))
    folder = F.concat(F.lit("fileinto:Item-"), F.col("item_id").cast("string"))
    return pairs.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("rule_no"), "words", F.when(F.col("i") % 3 == 0, "quarantine").otherwise(folder).alias("action"))


@query(
    with_tables(MAIL_SQL, _RULE_SQL)
    + "SELECT message_num, rule_no, CASE WHEN rule_no IS NULL THEN 'accept' WHEN (rule_no % 1000) % 3 = 1 THEN 'quarantine' ELSE 'fileinto:Item-' || (rule_no // 1000) END AS actions, rule_no IS NULL OR (rule_no % 1000) % 3 <> 1 AS accepted FROM mail LEFT JOIN best USING (message_num)"
)
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy that is a table of rules."""
    rows = rule_table.apply_rule_table(fixtures.messages(spark, sf_dir), saved(_rules(spark, sf_dir), "rules"))
    return verdicts.verdict(rows).select("message_num", "rule_no", shown("actions").alias("actions"), "accepted")


@query(with_tables(MAIL_SQL) + "SELECT message_num, CASE WHEN message_num % 3 = 0 THEN 'bounce' WHEN body = reverse(body) OR length(body) % 7 = 0 THEN 'fileinto:Odd' ELSE 'accept' END AS actions FROM mail")
def user_rules_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition in pandas behind a rule that stops."""

    def odd(body: pd.Series) -> pd.Series:
        return (body == body.str[::-1]) | (body.str.len() % 7 == 0)

    rules = [rule(F.col("message_num") % 3 == 0, policy.bounce(), stop=True), rule(vectorised(odd, F.col("body")), policy.fileinto("Odd"), stop=True), rule(True, policy.accept())]
    return policy.apply_policy(fixtures.messages(spark, sf_dir), Policy(rules)).select("message_num", shown("actions").alias("actions"))


@query(
    with_tables(MAIL_SQL)
    + """SELECT message_num, 'text/' || split_part(sender_domain, '.', 2) AS mime_type, spam_score + 0.5 AS spam_score, CASE message_num % 3 WHEN 0 THEN 'infected' WHEN 1 THEN 'unknown' ELSE 'clean' END AS virus_status,
  'did:mail:' || message_num AS did, CAST(message_num % 3 AS INTEGER) AS num_envelope, '10.0.0.' || (message_num % 256) AS sender_ip, 'cf' || src_no AS filter, 'filter ' || src_no AS filter_name,
  'max=' || src_no || ';scan=yes' AS rules, 'i' || (message_num % 5) AS instance, 'inst ' || (message_num % 5) AS instance_name, message_num % 2 = 0 AS listed, CASE WHEN message_num % 2 = 0 THEN 'zen.example' ELSE '' END AS rbl_name FROM mail"""
)
def message_fields_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every getter, of messages that have a value for each field."""
    number, source = F.col("message_num").cast("string"), F.col("src_no").cast("string")
    fifth, listed = (F.col("message_num") % 5).cast("string"), F.col("message_num") % 2 == 0
    given = {
        "mime_type": F.concat(F.lit("text/"), F.get(F.split("sender_domain", r"\."), F.lit(1))),
        "spam_score": F.col("spam_score") + 0.5,
        "virus_status": F.when(F.col("message_num") % 3 == 0, "infected").when(F.col("message_num") % 3 == 1, "unknown"),
        "sender_did": F.concat(F.lit("did:mail:"), number),
        "envelope_senders": F.array_repeat("sender", (F.col("message_num") % 3).cast("int")),
        "sender_ip": F.concat(F.lit("10.0.0."), (F.col("message_num") % 256).cast("string")),
        "content_filter": F.concat(F.lit("cf"), source),
        "content_filter_name": F.concat(F.lit("filter "), source),
        "content_filter_rules": F.create_map(F.lit("max"), source, F.lit("scan"), F.lit("yes")),
        "instance": F.concat(F.lit("i"), fifth),
        "instance_name": F.concat(F.lit("inst "), fifth),
        "rbl_listed": listed,
        "rbl_name": F.when(listed, "zen.example"),
    }
    getters = {
        "mime_type": fields.get_mime_type(), "spam_score": fields.get_spam_score(), "virus_status": fields.get_virus_status(), "did": fields.get_recipient_did(), "num_envelope": fields.num_envelope(),
        "sender_ip": fields.get_sender_ip(), "filter": fields.get_content_filter(), "filter_name": fields.get_content_filter_name(), "rules": shown_map("content_filter_rules"),
        "instance": fields.get_instance(), "instance_name": fields.get_instance_name(), "listed": fields.get_rbl_status()["listed"], "rbl_name": fields.get_rbl_status()["rbl_name"],
    }
    return from_columns(fixtures.mail(spark, sf_dir), given).select("message_num", *[c.alias(name) for name, c in getters.items()])


@query(with_tables(MAIL_SQL) + "SELECT CAST(least(count(*), 10) AS BIGINT) AS n, CAST(1 AS BIGINT) AS low, CAST(least(count(*), 10) AS BIGINT) AS high, CAST(1 AS BIGINT) AS files FROM mail")
def mbox_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten messages of all mail in mbox files; no more files are read than hold them."""
    rows = mailbox.read_mbox(spark, _written_mbox(spark, sf_dir), limit=10, unquote=True)
    return rows.agg(F.count("*").alias("n"), F.min("message_num").alias("low"), F.max("message_num").alias("high"), F.lit(len(rows.inputFiles())).cast("long").alias("files"))


@query(with_tables(MAIL_SQL) + _READ_SQL)
def maildir_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the mail put into a Maildir's folder new and read by a stream, then moved to cur while the other half comes: each message is read once."""
    path = fixtures.scratch(spark, "maildir-stream")
    raw, even = fixtures.raw_messages(spark, sf_dir), F.col("message_num") % 2 == 0
    for part, half in enumerate((even, ~even)):
        mailbox.write_maildir(raw.where(half), f"{path}/box")
        rows = mailbox.read_maildir(spark, f"{path}/box", stream=True)
        writer = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()
        if not part:
            _renamed(spark, f"{path}/box/new", f"{path}/box/cur")
    return _read_again(spark.read.parquet(f"{path}/out"))


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    """What a mail reader does to messages that it has shown: they move, and keep their names."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    files.Path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(files.Path(old), files.Path(new))


@query(
    with_tables(MAIL_SQL, DNS_SQL, RBL_SQL, "placed AS (SELECT message_num, coalesce(ip, '') AS ip FROM mail LEFT JOIN dns ON domain = sender_domain)")
    + "SELECT message_num, coalesce((SELECT min(zone) FROM rbl WHERE rbl.ip = placed.ip AND (message_num % 2 = 1 OR zone = 'zen.example')), '') AS rbl_name FROM placed"
)
def lookups_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose blocklist gets a new version after its first batch: even messages come before, odd ones after."""
    path = fixtures.scratch(spark, "changing")
    rows, listed = fixtures.messages(spark, sf_dir), fixtures.rbl(spark, sf_dir)
    feeds.store_snapshot(fixtures.dns(spark, sf_dir), f"{path}/dns", 0)
    look_up = lambda batch, tables: enrich.enrich_rbl(enrich.enrich_dns(batch, tables["dns"]), tables["rbl"])
    for version, zones in ((0, listed.where("zone = 'zen.example'")), (1, listed)):
        feeds.store_snapshot(zones, f"{path}/rbl", version)
        rows.where(F.col("message_num") % 2 == version).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        feeds.enriched_stream(stream, {"dns": f"{path}/dns", "rbl": f"{path}/rbl"}, look_up, f"{path}/out", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/out/rows").select("message_num", "rbl_name")


@query(
    with_tables(MAIL_SQL, _SPAM_SQL)
    + "SELECT count(*) AS processed, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM spammed"
)
def stored_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the batches of a stream add to a table."""
    path = fixtures.scratch(spark, "counters")
    results = feeds.process_stream(_mail_stream(spark, sf_dir), policies.spam_policy(SUBJECT, PHRASES, TRUSTED))
    feeds.store_stats(results, f"{path}/store", f"{path}/progress", "smtp").awaitTermination()
    return feeds.stored_stats(spark, f"{path}/store")


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT message_num, array_to_string(actions, ' | ') AS actions, CASE WHEN message_num % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM spammed")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a job written to one table, one of them twice, first with fewer rows."""
    path = fixtures.scratch(spark, "runs")
    rows = sinks.result_rows(verdicts.disposition(_spam(spark, sf_dir)), keep=("disposition",))
    even = F.col("message_num") % 2 == 0
    for run, part in (("even", rows.where(even & (F.col("message_num") % 3 == 0))), ("odd", rows.where(~even)), ("even", rows.where(even))):
        sinks.write_results(part, path, run=run)
    return spark.read.parquet(path).select("message_num", shown("actions").alias("actions"), "run")


@query(
    with_tables(MAIL_SQL, _SPAM_SQL)
    + "SELECT k AS kind, count(*) AS n_messages, (SELECT count(*) FROM spammed) AS total_processed FROM (SELECT message_num, unnest(list_distinct(list_transform(actions, lambda a: split_part(a, ':', 1)))) AS k FROM spammed) GROUP BY k"
)
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and messages of each kind of action, counted while a report is written."""
    summary = sinks.write_report(_spam(spark, sf_dir), fixtures.scratch(spark, "counted-report"))
    return summary.select(F.explode("kinds").alias("kind", "n_messages"), "total_processed")
