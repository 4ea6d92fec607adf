"""Registered queries of the mail engine and DuckDB SQL for the same rows.

Arrays are shown as texts joined by " | " and maps as sorted key=value pairs joined by ";", so both engines can be compared by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, predicates
from ..operators import dlp, enrich, order, policy, stats, verdicts
from ..operators.policy import Policy, rule
from ..sources import inbox, mailbox, messages, parse, sinks
from ..sources.tables import saved
from ..streaming import feeds
from . import fixtures, policies
from .fixtures import DNS_SQL, GATEWAY_SQL, MAIL_SQL, MX_SQL, RBL_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# What the policies look for in the test texts, in which the words of the shipped ones do not occur.
SUBJECT, PHRASES, TRUSTED = r"(?i)\bof the\b", ("All rights",), r"@company\.com$"
PHISHING, MOST_BYTES = r"(?i)\b(nicht|pour|avec)\b", 5000


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def shown(array: str | Column) -> Column:
    return F.array_join(array, " | ")


def shown_map(m: str) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def with_tables(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


# Fields and conditions


@query(with_tables(MAIL_SQL) + "SELECT message_num, sender_domain AS plain, sender_domain || '>' AS shown_raw, sender_domain AS shown_address, '' AS two, '' AS none FROM mail")
def sender_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("Bob <"), "sender", F.lit(">"))
    return fixtures.mail(spark, sf_dir).select(
        "message_num",
        fields.sender_domain(F.col("sender")).alias("plain"),
        fields.sender_domain(named).alias("shown_raw"),
        fields.sender_domain(named, "address").alias("shown_address"),
        fields.sender_domain(F.concat("sender", F.lit("@x"))).alias("two"),
        fields.sender_domain(F.lit("nobody")).alias("none"),
    )


@query(with_tables(MAIL_SQL) + "SELECT message_num, sender AS from_header, subject, '' AS absent, '' AS other_case FROM mail")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = fields.get_header
    return fixtures.messages(spark, sf_dir).select("message_num", get("From").alias("from_header"), get("Subject").alias("subject"), get("X-None").alias("absent"), get("from").alias("other_case"))


@query(
    with_tables(MAIL_SQL)
    + "SELECT message_num, 'text/plain' AS mime_type, spam_score, 'clean' AS virus_status, '' AS did, sender_domain, 0 AS num_envelope, '' AS sender_ip, '' AS filter, '' AS filter_name, '' AS rules, '' AS instance, '' AS instance_name, false AS listed, '' AS rbl_name FROM mail"
)
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.messages(spark, sf_dir)
    return rows.select(
        "message_num",
        fields.get_mime_type().alias("mime_type"),
        fields.get_spam_score().alias("spam_score"),
        fields.get_virus_status().alias("virus_status"),
        fields.get_recipient_did().alias("did"),
        fields.get_sender_domain().alias("sender_domain"),
        fields.num_envelope().alias("num_envelope"),
        fields.get_sender_ip().alias("sender_ip"),
        fields.get_content_filter().alias("filter"),
        fields.get_content_filter_name().alias("filter_name"),
        shown_map("content_filter_rules").alias("rules"),
        fields.get_instance().alias("instance"),
        fields.get_instance_name().alias("instance_name"),
        fields.get_rbl_status()["listed"].alias("listed"),
        fields.get_rbl_status()["rbl_name"].alias("rbl_name"),
    )


@query(with_tables(MAIL_SQL) + "SELECT message_num, contains(body, 'All rights') AS hit, contains(body, 'all rights') AS other_case, true AS empty FROM mail")
def body_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = predicates.body_contains
    return fixtures.messages(spark, sf_dir).select("message_num", has("All rights").alias("hit"), has("all rights").alias("other_case"), has("").alias("empty"))


_PATTERNS = {
    "keyword": (SUBJECT, "subject"), "anchored": (r"^The.*\.$", "subject"), "card": (dlp.PATTERNS["card"], "body"), "lines": (r"(?m)^From .*$", "body"), "dots": (r"the.and", "body"),
    "spaced": (r"[\s,]and[\s.]", "body"), "posix": (r"[[:upper:]]{4,}!", "body"), "folded": (r"(?i:ÉÉ)", "body"), "ends": (r"[^.]$", "body"),
}


@query(with_tables(MAIL_SQL) + "SELECT message_num, " + ", ".join(f"regexp_matches({text}, '{p}') AS {name}" for name, (p, text) in _PATTERNS.items()) + ", false AS invalid, false AS look_ahead FROM mail")
def regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [predicates.regex_match(p, F.col("body") if text == "body" else fields.get_header("Subject")).alias(name) for name, (p, text) in _PATTERNS.items()]
    return fixtures.messages(spark, sf_dir).select("message_num", *columns, predicates.regex_match("(", F.col("body")).alias("invalid"), predicates.regex_match("a(?=b)", F.col("body")).alias("look_ahead"))


# Policies

_SPAM_SQL = f"""spam AS (SELECT message_num, sender, sender_domain, body,
  CASE WHEN spam_score > 7 THEN 1 WHEN regexp_matches(subject, '{SUBJECT}') THEN 2 WHEN contains(body, 'All rights') THEN 3 WHEN sender_domain = 'company.com' THEN 4 ELSE 5 END AS k FROM mail),
spammed AS (SELECT message_num, sender, sender_domain, body, k,
  ['log:Checking message from: ' || sender] || CASE k WHEN 1 THEN ['log:High spam score: 8.5', 'quarantine'] WHEN 2 THEN ['log:Spam keywords detected in subject', 'fileinto:Spam']
    WHEN 3 THEN ['log:Suspicious content in body', 'fileinto:Spam'] WHEN 4 THEN ['log:Trusted sender domain', 'add_header:X-Trusted:yes', 'accept'] ELSE ['accept'] END AS actions,
  ['Checking message from: ' || sender] || CASE k WHEN 1 THEN ['High spam score: 8.5'] WHEN 2 THEN ['Spam keywords detected in subject'] WHEN 3 THEN ['Suspicious content in body']
    WHEN 4 THEN ['Trusted sender domain'] ELSE [] END AS logs,
  CASE k WHEN 4 THEN 'X-Trusted=yes' ELSE '' END AS modified_headers,
  k > 3 AS accepted, CASE k WHEN 1 THEN 'Message quarantined' WHEN 2 THEN 'Classified as spam' WHEN 3 THEN 'Classified as spam' ELSE '' END AS reason FROM spam)"""


def _spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.apply_policy(fixtures.messages(spark, sf_dir), policies.spam_policy(SUBJECT, PHRASES, TRUSTED))


def _shown_results(rows: DataFrame) -> DataFrame:
    return rows.select("message_num", shown("actions").alias("actions"), shown("logs").alias("logs"), shown_map("modified_headers").alias("modified_headers"), "accepted", "reason")


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT message_num, array_to_string(actions, ' | ') AS actions, array_to_string(logs, ' | ') AS logs, modified_headers, accepted, reason FROM spammed")
def spam_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_results(verdicts.verdict(_spam(spark, sf_dir)))


@query(
    with_tables(MAIL_SQL)
    + """SELECT message_num, 'log:Checking message from: ' || sender || CASE WHEN spam_score > 7 THEN ' | log:High spam score: 8.5 | quarantine'
  WHEN regexp_matches(subject, '(?i)(viagra|cialis|casino|lottery|winner|prize)') THEN ' | log:Spam keywords detected in subject | fileinto:Spam'
  WHEN contains(body, 'click here now') OR contains(body, 'limited time offer') THEN ' | log:Suspicious content in body | fileinto:Spam'
  WHEN regexp_matches(sender, '@(example\\.com|trusted\\.org)$') THEN ' | log:Trusted sender domain | add_header:X-Trusted:yes | accept' ELSE ' | accept' END AS actions FROM mail"""
)
def spam_policy_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.apply_policy(fixtures.messages(spark, sf_dir), policies.spam_policy()).select("message_num", shown("actions").alias("actions"))


_CORPORATE_SQL = f"""corp AS (SELECT message_num, sender, sender_domain <> 'company.com' AS external, strlen(body) AS n,
  CASE WHEN strlen(body) > {MOST_BYTES} THEN 1 WHEN regexp_matches(body, '{dlp.PATTERNS["card"]}') THEN 2 WHEN regexp_matches(body, '{dlp.PATTERNS["ssn"]}') THEN 3
       WHEN sender_domain <> 'company.com' AND regexp_matches(subject, '{PHISHING}') THEN 4 ELSE 5 END AS k FROM mail)"""


@query(
    with_tables(MAIL_SQL, _CORPORATE_SQL)
    + """SELECT message_num, CASE WHEN external THEN 'log:External email from: ' || sender || ' | add_header:X-External-Mail:yes | ' ELSE '' END || CASE k
  WHEN 1 THEN 'log:Large attachment blocked: ' || n || ' bytes | bounce' WHEN 2 THEN 'log:Credit card pattern detected | set_dlp:quarantine:compliance@company.com'
  WHEN 3 THEN 'log:SSN pattern detected | set_dlp:quarantine:compliance@company.com' WHEN 4 THEN 'log:Potential phishing email | fileinto:Quarantine' ELSE 'accept' END AS actions,
  CASE WHEN external THEN 'X-External-Mail=yes' ELSE '' END AS modified_headers, k <> 1 AS accepted, CASE WHEN k = 1 THEN 'Message bounced' ELSE 'Message accepted' END AS reason FROM corp"""
)
def corporate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.apply_policy(fixtures.messages(spark, sf_dir), policies.corporate_policy(phishing=PHISHING, most_bytes=MOST_BYTES))
    return _shown_results(verdicts.verdict(rows, "last")).drop("logs")


#: A policy whose rules do not exclude each other, so that the first and the last rejecting action differ.
_MANY_SQL = """many AS (SELECT message_num, list_filter([CASE WHEN message_num % 2 = 0 THEN 'accept' END, CASE WHEN message_num % 3 = 0 THEN 'fileinto:SpamTrap' END,
  CASE WHEN message_num % 5 = 0 THEN 'quarantine' END, CASE WHEN message_num % 7 = 0 THEN 'smtp_error:550' END, CASE WHEN message_num % 11 = 0 THEN 'drop' END, CASE WHEN message_num % 13 = 0 THEN 'discard' END],
  lambda x: x IS NOT NULL) AS actions, CASE WHEN message_num % 17 = 0 THEN 'boom' END AS error FROM mail),
judged AS (SELECT message_num, CASE WHEN error IS NULL THEN actions ELSE [] END AS actions, error,
  CASE WHEN error IS NULL THEN list_filter(actions, lambda x: x IN ('discard', 'quarantine', 'bounce', 'drop') OR starts_with(x, 'fileinto:Spam')) ELSE [] END AS bad FROM many)"""
_REASON_SQL = "CASE {0} WHEN 'discard' THEN 'Message discarded by filter' WHEN 'quarantine' THEN 'Message quarantined' WHEN 'bounce' THEN 'Message bounced' WHEN 'drop' THEN 'Message dropped' WHEN 'fileinto:SpamTrap' THEN 'Classified as spam' ELSE '{1}' END"


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda n: F.col("message_num") % n == 0
    rules = [
        rule(by(2), policy.accept()),
        rule(by(3), policy.fileinto("SpamTrap")),
        rule(by(5), policy.quarantine()),
        rule(by(7), policy.reply_with_smtp_error(550)),
        rule(by(11), policy.drop()),
        rule(by(13), policy.discard()),
    ]
    rows = fixtures.messages(spark, sf_dir).withColumn("error", F.when(by(17), "boom"))
    return policy.apply_policy(rows, Policy(rules))


@query(with_tables(MAIL_SQL, _MANY_SQL) + f"SELECT message_num, error IS NULL AND len(bad) = 0 AS accepted, CASE WHEN error IS NOT NULL THEN 'Script execution error' ELSE {_REASON_SQL.format('bad[1]', '')} END AS reason FROM judged")
def verdict_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdict(_many(spark, sf_dir), "first").select("message_num", "accepted", "reason")


@query(with_tables(MAIL_SQL, _MANY_SQL) + f"SELECT message_num, error IS NULL AND len(bad) = 0 AS accepted, CASE WHEN error IS NOT NULL THEN 'Script error: boom' ELSE {_REASON_SQL.format('bad[-1]', 'Message accepted')} END AS reason FROM judged")
def verdict_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdict(_many(spark, sf_dir), "last").select("message_num", "accepted", "reason")


@query(
    with_tables(MAIL_SQL)
    + """SELECT message_num, CASE WHEN message_num % 2 = 0 THEN 'add_header:X-A:1 | ' ELSE '' END || 'add_header:X-B:' || sender_domain || ' | add_header:X-A:2 | add_header:Subject:s:t' AS actions,
  'Subject=s:t;X-A=2;X-B=' || sender_domain AS modified_headers, 'Content-Type=text/plain;From=' || sender || ';Subject=s:t;To=inbox@company.com;X-A=2;X-B=' || sender_domain AS applied FROM mail"""
)
def header_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = [rule(F.col("message_num") % 2 == 0, policy.add_header("X-A", "1")), rule(True, policy.add_header("X-B", F.col("sender_domain")), policy.add_header("X-A", "2"), policy.add_header("Subject", "s:t"))]
    rows = policy.apply_policy(fixtures.messages(spark, sf_dir), Policy(edits))
    rows = rows.withColumn("applied", policy.applied_headers(F.col("headers"), F.col("modified_headers")))
    return rows.select("message_num", shown("actions").alias("actions"), shown_map("modified_headers").alias("modified_headers"), shown_map("applied").alias("applied"))


@query(with_tables(MAIL_SQL) + "SELECT message_num, CASE WHEN spam_score > 7 THEN 'discard' ELSE 'accept' END AS actions, CASE WHEN spam_score > 7 THEN 'discard' ELSE '' END AS without FROM mail")
def default_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule(fields.get_spam_score() > 7, policy.discard())]
    rows = policy.apply_policy(fixtures.messages(spark, sf_dir), Policy(rules)).withColumn("without", shown("actions"))
    return policy.apply_policy(rows, Policy(rules, default_accept=True)).select("message_num", shown("actions").alias("actions"), "without")


# The action string of each emitter, for the arguments in emitters().
_EMITTED = [
    "accept",
    "discard",
    "drop",
    "bounce",
    "quarantine",
    "fileinto:Box",
    "auto_reply:a:b",
    "divert_to:x@y",
    "screen_to:x@y",
    "skip_malware_check:s",
    "skip_spam_check:s",
    "skip_whitelist_check:10.0.0.1",
    "force_second_pass:srv",
    "set_dlp:m:t",
    "skip_dlp:m:t",
    "add_to_digest",
    "smtp_error:550",
    "smtp_dsn:5.7.1",
    "set_filter_rules:r",
    "log:m",
    "add_header:n:v:w",
    "rbl_check:fd00::1:zen",
    "mx_rbl_check:d:zen",
    "domain_resolve:s:true",
]


def emitters() -> list[policy.Effect]:
    return [
        policy.accept(),
        policy.discard(),
        policy.drop(),
        policy.bounce(),
        policy.quarantine(),
        policy.fileinto("Box"),
        policy.auto_reply("a:b"),
        policy.divert_to("x@y"),
        policy.screen_to("x@y"),
        policy.skip_malware_check("s"),
        policy.skip_spam_check("s"),
        policy.skip_whitelist_check("10.0.0.1"),
        policy.force_second_pass("srv"),
        policy.set_dlp("m", "t"),
        policy.skip_dlp("m", "t"),
        policy.add_to_next_digest(),
        policy.reply_with_smtp_error(550),
        policy.reply_with_smtp_dsn("5.7.1"),
        policy.set_content_filter_rules("r"),
        policy.log_entry("m"),
        policy.add_header("n", "v:w"),
        policy.rbl_check("fd00::1", "zen"),
        policy.mx_in_rbl("d", "zen"),
        policy.domain_resolution("s", True),
    ]



@query(with_tables(MAIL_SQL) + "SELECT message_num, '" + " | ".join(_EMITTED) + " | divert_to:' || sender AS actions FROM mail")
def action_emitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule(True, *emitters(), policy.divert_to(F.col("sender")))]
    return policy.apply_policy(fixtures.messages(spark, sf_dir), Policy(rules)).select("message_num", shown("actions").alias("actions"))


@query(with_tables(MAIL_SQL) + "SELECT message_num, CASE WHEN length(body) % 2 = 1 AND lower(subject) LIKE 't%' THEN 'fileinto:Odd-' || length(body) ELSE 'accept' END AS actions FROM mail")
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any column is a condition or an argument."""
    odd = (F.length("body") % 2 == 1) & F.lower(fields.get_header("Subject")).startswith("t")
    rules = [rule(odd, policy.fileinto(F.concat(F.lit("Odd-"), F.length("body").cast("string"))), stop=True), rule(True, policy.accept())]
    return policy.apply_policy(fixtures.messages(spark, sf_dir), Policy(rules)).select("message_num", shown("actions").alias("actions"))


# Results


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT a AS action, count(*) AS n FROM (SELECT unnest(actions) AS a FROM spammed) GROUP BY a")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.action_counts(_spam(spark, sf_dir))


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT split_part(a, ':', 1) AS kind, count(*) AS n_actions, count(DISTINCT message_num) AS n_messages FROM (SELECT message_num, unnest(actions) AS a FROM spammed) GROUP BY 1")
def action_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.action_kind_counts(_spam(spark, sf_dir))


@query(
    with_tables(MAIL_SQL, _SPAM_SQL, "acts AS (SELECT message_num, unnest(actions) AS a, unnest(range(len(actions))) AS pos FROM spammed)")
    + """SELECT message_num, pos, split_part(a, ':', 1) AS kind, CASE WHEN starts_with(a, 'add_header:') THEN split_part(a, ':', 2) WHEN contains(a, ':') THEN substr(a, strpos(a, ':') + 1) END AS arg1,
  CASE WHEN starts_with(a, 'add_header:') THEN split_part(a, ':', 3) END AS arg2 FROM acts"""
)
def route_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.route_actions(_spam(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT message_num, CASE k WHEN 1 THEN 'quarantine' WHEN 2 THEN 'Spam' WHEN 3 THEN 'Spam' ELSE 'inbox' END AS disposition FROM spammed")
def disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.disposition(_spam(spark, sf_dir)).select("message_num", "disposition")


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT accepted, reason, count(*) AS n FROM spammed GROUP BY ALL")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reason_counts(verdicts.verdict(_spam(spark, sf_dir)))


@query(
    with_tables(GATEWAY_SQL)
    + """SELECT count(*) FILTER (path = 'smtp' OR error IS NULL) AS processed, count(*) FILTER (error IS NULL AND accepted) AS accepted,
  count(*) FILTER ((path = 'smtp' OR error IS NULL) AND NOT (error IS NULL AND accepted)) AS rejected, CAST(coalesce(sum(bytes) FILTER (path = 'smtp'), 0) AS BIGINT) AS bytes FROM gateway"""
)
def gateway_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.gateway_stats(fixtures.gateway(spark, sf_dir))


@query(with_tables(MAIL_SQL, _MANY_SQL) + "SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded FROM judged")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_summary(_many(spark, sf_dir))


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT message_num, sender AS \"from\", array_to_string(actions, ' | ') AS actions, CASE k WHEN 1 THEN 'quarantine' WHEN 2 THEN 'Spam' WHEN 3 THEN 'Spam' ELSE 'inbox' END AS disposition FROM spammed")
def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by disposition and read again."""
    path = fixtures.scratch(spark, "results")
    rows = sinks.result_rows(verdicts.disposition(_spam(spark, sf_dir)), keep=("disposition",))
    sinks.write_results(rows, path)
    return spark.read.parquet(path).select("message_num", "from", shown("actions").alias("actions"), "disposition")


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT message_num, array_to_string(logs, ' | ') AS logs, CASE WHEN k = 4 THEN 'yes' END AS trusted, (SELECT count(*) FROM spammed) AS total_processed FROM spammed")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report written and read again, with its total."""
    path = fixtures.scratch(spark, "report")
    sinks.write_report(_spam(spark, sf_dir), path)
    rows = spark.read.schema("message_num long, logs array<string>, modified_headers map<string,string>").json(f"{path}/messages")
    total = spark.read.schema("total_processed long").json(f"{path}/summary")
    return rows.select("message_num", shown("logs").alias("logs"), F.try_element_at("modified_headers", F.lit("X-Trusted")).alias("trusted")).join(F.broadcast(total))


# Sources and order


@query(with_tables(MAIL_SQL) + "SELECT message_num, 'From=' || sender || ';Received=r1;Subject=' || subject || ';To=' || recipient AS headers, body, 'r1 | r2' AS received, sender_domain FROM mail")
def parse_headers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_messages(fixtures.raw_messages(spark, sf_dir), "first")
    return rows.select("message_num", shown_map("headers").alias("headers"), "body", shown("received_headers").alias("received"), "sender_domain")


@query(with_tables(MAIL_SQL) + "SELECT message_num, 'From=' || sender || ';Received=r2;Subject=' || subject || ';To=' || recipient || ';received=r1' AS headers, body, 'r2' AS received, sender_domain FROM mail")
def parse_headers_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_messages(fixtures.raw_messages(spark, sf_dir), "last")
    return rows.select("message_num", shown_map("headers").alias("headers"), "body", shown("received_headers").alias("received"), "sender_domain")


@query(with_tables(MAIL_SQL) + "SELECT message_num, 'r1' AS newest, CASE message_num % 4 WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' ELSE '' END AS at_level, '' AS before FROM mail")
def received_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_messages(fixtures.raw_messages(spark, sf_dir))
    level = fields.check_received_header
    return rows.select("message_num", level(0).alias("newest"), level((F.col("message_num") % 4).cast("int")).alias("at_level"), level(-1).alias("before"))


@query(with_tables(MAIL_SQL) + "SELECT message_num, strlen(body) AS body_size, strlen('From: ' || sender || 'xTo: ' || recipient || 'xSubject: ' || subject || 'xreceived: r1xReceived: r2') AS header_size FROM mail")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_messages(fixtures.raw_messages(spark, sf_dir))
    return rows.select("message_num", fields.body_size().alias("body_size"), fields.header_size().alias("header_size"))


_READ_SQL = "SELECT sender, subject, body || chr(10) AS body, 'r1 | r2' AS received FROM mail"


def _read_again(rows: DataFrame) -> DataFrame:
    return parse.parse_messages(rows).select("sender", "subject", "body", shown("received_headers").alias("received"))


def _written_mbox(spark: SparkSession, sf_dir: str) -> str:
    path = fixtures.scratch(spark, "mbox")
    quoted = F.regexp_replace("raw", "(?m)^(>*From )", ">$1")
    fixtures.raw_messages(spark, sf_dir).select(F.concat(F.lit("From sender Thu Jan  1 00:00:00 1970\n"), quoted).alias("value")).write.text(path)
    return path


@query(with_tables(MAIL_SQL) + _READ_SQL)
def mbox_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mail written as mbox files, boundary-like lines quoted, and read again."""
    return _read_again(mailbox.read_mbox(spark, _written_mbox(spark, sf_dir), unquote=True))


@query(with_tables(MAIL_SQL) + _READ_SQL)
def maildir_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mail written as a Maildir, one file for each message, and read again."""
    path = fixtures.scratch(spark, "maildir")
    mailbox.write_maildir(fixtures.raw_messages(spark, sf_dir), path, F.when(F.col("message_num") % 2 == 0, "cur").otherwise("new"))
    return _read_again(mailbox.read_maildir(spark, path))


@query(with_tables(MAIL_SQL) + "SELECT count(*) AS n, count(*) AS numbers, 1 AS low, count(*) AS high, least(count(*), 100) AS limited FROM mail")
def message_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all messages of an mbox, and how many a limit keeps."""
    path = _written_mbox(spark, sf_dir)
    rows = mailbox.read_mbox(spark, path, unquote=True, numbered=True)
    number = F.col("message_num")
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct(number).alias("numbers"), F.min(number).cast("int").alias("low"), F.max(number).alias("high"))
    return counts.join(F.broadcast(mailbox.read_mbox(spark, path, limit=100, unquote=True).agg(F.count("*").alias("limited"))))


@query(with_tables(MAIL_SQL) + "SELECT row_number() OVER (ORDER BY message_num % 2, message_num) AS place, message_num FROM mail QUALIFY place <= 100")
def message_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first messages of two folders, one after the other."""
    rows = fixtures.mail(spark, sf_dir).select("message_num")
    both = order.concat_folders(rows.where("message_num % 2 = 0"), rows.where("message_num % 2 = 1"))
    numbered = order.number_messages(both, [F.col("folder_rank"), F.floor(F.col("message_num") / 1000)], "message_num", "place")
    return order.first_messages(numbered, 100, "place").select("place", "message_num")


def _inbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("message_num") % 3 == 0
    raw = F.concat(F.lit("X-Num: "), F.col("message_num").cast("string"), F.lit("\nSubject: raw "), F.col("message_num").cast("string"))
    return fixtures.mail(spark, sf_dir).select(
        "sender",
        "subject",
        F.when(F.col("message_num") % 2 == 0, raw).alias("raw_headers"),
        F.when(third, "").otherwise(F.col("body")).alias("body_plain"),
        F.concat(F.lit("<p>"), "body", F.lit("</p>")).alias("body_html"),
        "spam_score",
    )


@query(with_tables(MAIL_SQL) + "SELECT sender, sender_domain, CASE WHEN message_num % 2 = 0 THEN 'raw ' || message_num ELSE subject END AS subject, CASE WHEN message_num % 2 = 0 THEN CAST(message_num AS VARCHAR) ELSE '' END AS x_num, CASE WHEN message_num % 3 = 0 THEN '<p>' || body || '</p>' ELSE body END AS body, spam_score FROM mail")
def inbox_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fixtures.scratch(spark, "inbox")
    _inbox_rows(spark, sf_dir).write.json(path)
    return inbox.read_inbox_json(spark, path).select("sender", "sender_domain", fields.get_header("Subject").alias("subject"), fields.get_header("X-Num").alias("x_num"), "body", "spam_score")


@query(
    with_tables(MAIL_SQL)
    + """SELECT CASE WHEN message_num % 4 = 0 THEN '' ELSE sender END AS sender, CASE WHEN message_num % 4 = 1 THEN '' ELSE subject END AS subject, CASE WHEN message_num % 4 IN (2, 3) THEN '' ELSE body END AS body,
  CASE WHEN message_num % 4 = 3 THEN 0.0 ELSE spam_score END AS spam_score FROM mail"""
)
def inbox_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox rows in which one field has another JSON type than it should: a number, a truth value, an object, a text."""
    path = fixtures.scratch(spark, "inbox")
    kind = F.col("message_num") % 4
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x")))  # noqa: E731  {"x":...}
    value = lambda c: F.substr(quoted(c), F.lit(6), F.length(quoted(c)) - 6)
    line = F.concat(
        F.lit('{"sender":'), F.when(kind == 0, F.col("message_num").cast("string")).otherwise(value("sender")),
        F.lit(',"subject":'), F.when(kind == 1, "true").otherwise(value("subject")),
        F.lit(',"body_plain":'), F.when(kind == 2, F.concat(F.lit('{"a":'), value("body"), F.lit("}"))).when(kind == 3, "[1]").otherwise(value("body")),
        F.lit(',"spam_score":'), F.when(kind == 3, F.concat(F.lit('"'), F.col("spam_score").cast("string"), F.lit('"'))).otherwise(F.col("spam_score").cast("string")), F.lit("}"),
    )
    fixtures.mail(spark, sf_dir).select(line.alias("value")).write.text(path)
    return inbox.read_inbox_json(spark, path).select("sender", fields.get_header("Subject").alias("subject"), "body", "spam_score")


@query(with_tables(MAIL_SQL) + "SELECT message_num, CASE message_num % 3 WHEN 0 THEN '10.' || src_no || '.0.' || message_num % 250 WHEN 1 THEN '192.0.2.' || src_no ELSE '' END AS ip FROM mail")
def received_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address in the newest Received header of messages with several ones."""
    number = F.col("message_num")
    newest = F.when(number % 3 == 0, F.format_string("from a ([10.%d.0.%d]) by b", "src_no", number % 250)).when(number % 3 == 1, F.format_string("from 192.0.2.%d; 1.2.3.4.5", "src_no")).otherwise("from nowhere 1.2.3")
    raw = F.concat(F.lit("From: x\nReceived: "), newest, F.lit("\nReceived: from c ([203.0.113.9])\n\n"), "body")
    rows = parse.parse_messages(fixtures.mail(spark, sf_dir).select("message_num", "src_no", raw.alias("raw")))
    return rows.select("message_num", fields.received_ip().alias("ip"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.when(F.col("message_num") % 2 == 0, F.array("recipient")).otherwise(F.array("recipient", "sender"))
    headers = F.create_map(F.lit("Subject"), F.col("subject"), F.lit("X-Envelope-From"), F.lit("forged"))
    return fixtures.mail(spark, sf_dir).select("message_num", F.col("sender").alias("from"), to.alias("to"), headers.alias("headers"), "body", F.lit(False).alias("forward_to_upstream"))


@query(
    with_tables(MAIL_SQL)
    + "SELECT message_num, sender_domain, subject, sender AS x_from, CASE WHEN message_num % 2 = 0 THEN recipient ELSE recipient || ', ' || sender END AS x_to, 1 AS num_envelope, 0.0::DOUBLE AS spam_score, 'clean' AS virus_status FROM mail"
)
def envelope_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages.from_requests(_requests(spark, sf_dir))
    get = fields.get_header
    return rows.select("message_num", "sender_domain", get("Subject").alias("subject"), get("X-Envelope-From").alias("x_from"), get("X-Envelope-To").alias("x_to"), fields.num_envelope().alias("num_envelope"), "spam_score", "virus_status")


# Lookups


@query(
    with_tables(MAIL_SQL)
    + f"""SELECT message_num, len(regexp_extract_all(body, '{dlp.PATTERNS["card"]}')) AS cards, len(regexp_extract_all(body, '{dlp.PATTERNS["ssn"]}')) AS ssns, len(regexp_extract_all(body, '\\d+\\.\\d+\\.\\d+\\.\\d+')) AS addresses,
  array_to_string(list_filter([CASE WHEN regexp_matches(body, '{dlp.PATTERNS["card"]}') THEN 'card' END, CASE WHEN regexp_matches(body, '{dlp.PATTERNS["ssn"]}') THEN 'ssn' END, CASE WHEN regexp_matches(body, '\\d+\\.\\d+\\.\\d+\\.\\d+') THEN 'ip' END], lambda x: x IS NOT NULL), ' | ') AS hits FROM mail"""
)
def dlp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dlp.dlp_scan(fixtures.messages(spark, sf_dir), dlp.PATTERNS | {"ip": r"\d+\.\d+\.\d+\.\d+"})
    n = lambda k: F.col("dlp_counts")[k].cast("long")
    return rows.select("message_num", n("card").alias("cards"), n("ssn").alias("ssns"), n("ip").alias("addresses"), shown("dlp_hits").alias("hits"))


@query(with_tables(MAIL_SQL, DNS_SQL) + "SELECT message_num, ip IS NOT NULL AS dns_resolved, coalesce(ip, '') AS sender_ip FROM mail LEFT JOIN dns ON sender_domain = domain")
def dns_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_dns(fixtures.messages(spark, sf_dir), fixtures.dns(spark, sf_dir)).select("message_num", "dns_resolved", "sender_ip")


@query(with_tables(MAIL_SQL, MX_SQL, "hosts AS (SELECT domain, string_agg(host, ' | ' ORDER BY pref, host) AS h FROM mx GROUP BY domain)") + "SELECT message_num, coalesce(h, '') AS mx_records, h IS NOT NULL AS valid_mx FROM mail LEFT JOIN hosts ON sender_domain = domain")
def mx_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_mx(fixtures.messages(spark, sf_dir), fixtures.mx(spark, sf_dir)).select("message_num", shown("mx_records").alias("mx_records"), "valid_mx")


@query(with_tables(MAIL_SQL, MX_SQL, "six AS (SELECT domain, bool_or(NOT contains(ip, ':')) AS v4, bool_or(contains(ip, ':')) AS v6 FROM mx GROUP BY domain)") + "SELECT message_num, coalesce(v4, false) AS is_mx_ipv4, coalesce(v6, false) AS is_mx_ipv6 FROM mail LEFT JOIN six ON sender_domain = domain")
def mx_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_mx_family(fixtures.messages(spark, sf_dir), fixtures.mx(spark, sf_dir)).select("message_num", "is_mx_ipv4", "is_mx_ipv6")


_AT_SQL = "placed AS (SELECT message_num, coalesce(ip, '') AS sender_ip FROM mail LEFT JOIN dns ON sender_domain = domain)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_dns(fixtures.messages(spark, sf_dir), saved(fixtures.dns(spark, sf_dir), "dns"))


@query(
    with_tables(MAIL_SQL, DNS_SQL, RBL_SQL, _AT_SQL, "one AS (SELECT ip, min(zone) AS zone, bool_or(zone = 'zen.example') AS zen FROM rbl GROUP BY ip)")
    + "SELECT message_num, zone IS NOT NULL AS rbl_listed, coalesce(zone, '') AS rbl_name, coalesce(zen, false) AS in_zen FROM placed LEFT JOIN one ON sender_ip = ip"
)
def rbl_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = saved(fixtures.rbl(spark, sf_dir), "rbl")  # a snapshot is a stored table, whose rows are counted by its footers
    rows = enrich.enrich_rbl(_placed(spark, sf_dir), listed, "zen.example").withColumn("in_zen", F.col("rbl_listed"))
    return enrich.enrich_rbl(rows, listed).select("message_num", "rbl_listed", "rbl_name", "in_zen")


@query(with_tables(MAIL_SQL, DNS_SQL, RBL_SQL, _AT_SQL) + "SELECT message_num, sender_ip FROM placed WHERE sender_ip IN (SELECT ip FROM rbl)")
def rbl_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.only_listed(_placed(spark, sf_dir), fixtures.rbl(spark, sf_dir)).select("message_num", "sender_ip")


@query(with_tables(MAIL_SQL, DNS_SQL, RBL_SQL, _AT_SQL) + "SELECT message_num, sender_ip FROM placed WHERE sender_ip NOT IN (SELECT ip FROM rbl)")
def rbl_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.only_clean(_placed(spark, sf_dir), fixtures.rbl(spark, sf_dir)).select("message_num", "sender_ip")


@query(with_tables(MAIL_SQL, MX_SQL, RBL_SQL) + "SELECT message_num, sender_domain IN (SELECT domain FROM mx WHERE ip IN (SELECT ip FROM rbl)) AS mx_in_rbl FROM mail")
def mx_in_rbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_mx_rbl(fixtures.messages(spark, sf_dir), fixtures.mx(spark, sf_dir), fixtures.rbl(spark, sf_dir)).select("message_num", "mx_in_rbl")


@query(
    with_tables(MAIL_SQL, DNS_SQL, MX_SQL)
    + "SELECT message_num, sender_domain IN (SELECT domain FROM dns) AS resolves, sender_domain IN (SELECT domain FROM dns) AND sender_domain IN (SELECT domain FROM mx) AS verified FROM mail"
)
def domain_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, hosts = fixtures.dns(spark, sf_dir), fixtures.mx(spark, sf_dir)
    rows = enrich.resolve_domain(fixtures.messages(spark, sf_dir), names).withColumnRenamed("domain_resolves", "resolves")
    return enrich.resolve_domain(rows, names, hosts, verify=True).select("message_num", "resolves", F.col("domain_resolves").alias("verified"))


@query(
    with_tables(MAIL_SQL)
    + "SELECT message_num, 'inst-' || src_no % 3 AS instance_name, 'cf' || src_no % 3 AS content_filter, 'filter ' || src_no % 3 AS content_filter_name, 'max=max-' || src_no % 3 || ';scan=scan-' || src_no % 3 AS rules FROM mail"
)
def attach_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.messages(spark, sf_dir).withColumn("instance", (F.col("src_no") % 3).cast("string"))
    rows = enrich.attach_config(rows, fixtures.config(spark, sf_dir))
    return rows.select("message_num", "instance_name", "content_filter", "content_filter_name", shown_map("content_filter_rules").alias("rules"))


# Streams


def _fed(rows: DataFrame, key: str, path: str, fmt: str, parts: int = 4) -> int:
    """Write ``rows`` as files of ``parts`` parts, dealt out by a hash of ``key``, and say how many files make a part.

    Each task writes its own rows to a file for each part, so a larger table has more files and not larger ones.
    """
    rows.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(parts))).write.partitionBy("part_").format(fmt).save(path)
    files = len(rows.sparkSession.read.schema(rows.schema).format(fmt).load(path).inputFiles())
    if not files:  # an empty table is a file without rows
        rows.limit(0).write.mode("append").format(fmt).save(path)
    return max(1, math.ceil(files / parts))


def _mail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a stream of several files, in four batches."""
    path = fixtures.scratch(spark, "feed")
    rows = fixtures.messages(spark, sf_dir)
    share = _fed(rows, "message_num", path, "parquet")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", share).parquet(path).select(*rows.columns)


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT message_num, array_to_string(actions, ' | ') AS actions, accepted, CASE WHEN accepted THEN 'Message accepted' ELSE reason END AS reason FROM spammed")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy over a stream, written by a streaming query and read again."""
    out = fixtures.scratch(spark, "stream")
    results = feeds.process_stream(_mail_stream(spark, sf_dir), policies.spam_policy(SUBJECT, PHRASES, TRUSTED))
    sinks.write_results(results, f"{out}/rows", None, checkpoint=f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("message_num", shown("actions").alias("actions"), "accepted", "reason")


@query(
    with_tables(MAIL_SQL, _SPAM_SQL, "came AS (SELECT *, message_num % 2 = 0 AS smtp, message_num % 7 = 0 AS failed FROM spammed)")
    + "SELECT count(*) FILTER (smtp OR NOT failed) AS processed, count(*) FILTER (accepted AND NOT failed) AS accepted, count(*) FILTER ((smtp OR NOT failed) AND NOT (accepted AND NOT failed)) AS rejected, CAST(sum(strlen(body)) FILTER (smtp) AS BIGINT) AS bytes FROM came"
)
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream whose messages come by both paths, some with an error."""
    failed = _mail_stream(spark, sf_dir).withColumn("error", F.when(F.col("message_num") % 7 == 0, "failed"))
    results = feeds.process_stream(failed, policies.spam_policy(SUBJECT, PHRASES, TRUSTED))
    name = f"running_stats_{abs(hash(sf_dir)) % 10**8}"
    writer = feeds.running_stats(results, F.when(F.col("message_num") % 2 == 0, "smtp").otherwise("rpc")).writeStream.format("memory").queryName(name).outputMode("complete")
    writer.option("checkpointLocation", fixtures.scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(with_tables(MAIL_SQL, _SPAM_SQL) + "SELECT sender, accepted, count(*) AS n FROM spammed GROUP BY ALL")
def monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON inbox files, watched until all that is there has been handled."""
    path = fixtures.scratch(spark, "watched")
    plain = fixtures.mail(spark, sf_dir).select("sender", "subject", F.lit("").alias("raw_headers"), F.col("body").alias("body_plain"), F.lit("").alias("body_html"), "spam_score")
    share = _fed(plain, "sender", f"{path}/in", "json")
    feeds.monitor(spark, f"{path}/in", policies.spam_policy(SUBJECT, PHRASES, TRUSTED), f"{path}/out", f"{path}/progress", interval=None, max_files=2 * share).awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("sender", "accepted").agg(F.count("*").alias("n"))
