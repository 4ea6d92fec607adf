"""Mail, DNS, mail host, blocklist, settings and gateway tables derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.messages import from_columns
from ..sources.tables import scratch as scratch


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: message_num, sender, recipient, subject, body, spam_score, sender_domain, src_no."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    number, inside = F.col("doc_id").cast("string"), F.col("doc_id") % 10 == 0
    domain = F.when(inside, "company.com").otherwise(F.concat("source", F.lit("."), "lang", F.lit(".example.com")))
    return rows.select(
        F.col("doc_id").alias("message_num"),
        F.concat(F.lit("u"), number, F.lit("@"), domain).alias("sender"),
        F.lit("inbox@company.com").alias("recipient"),
        F.trim(F.substring_index("text", "\n", 1)).alias("subject"),
        F.col("text").alias("body"),
        F.when(F.col("toxic") == 1, 8.5).when(F.col("quality") == 0, 6.0).otherwise(0.0).alias("spam_score"),
        domain.alias("sender_domain"),
        F.substring("source", 4, 9).cast("int").alias("src_no"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail in the message schema, with recipient and src_no."""
    headers = F.create_map(F.lit("From"), F.col("sender"), F.lit("To"), F.col("recipient"), F.lit("Subject"), F.col("subject"), F.lit("Content-Type"), F.lit("text/plain"))
    return from_columns(mail(spark, sf_dir), {"headers": headers, "mime_type": F.lit("text/plain")}, keep=("recipient", "src_no"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_num and raw: the mail as text with headers, two of which are Received in different spelling."""
    made = F.concat(F.lit("From: "), "sender", F.lit("\nTo: "), "recipient", F.lit("\nSubject: "), "subject", F.lit("\nreceived: r1\nReceived: r2\n\n"), "body")
    return mail(spark, sf_dir).select("message_num", made.alias("raw"))


def _senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail(spark, sf_dir).where("sender_domain <> 'company.com'").select("sender_domain", "src_no").distinct()


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _senders(spark, sf_dir).where("src_no % 5 <> 0").select(F.col("sender_domain").alias("domain"), F.format_string("10.0.%d.1", "src_no").alias("ip"))


def mx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _senders(spark, sf_dir).where("src_no % 3 <> 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    six = (F.col("k") == 2) & (F.col("src_no") % 4 == 0)
    ip = F.when(six, F.format_string("fd00::%d", "src_no")).otherwise(F.format_string("10.1.%d.%d", "src_no", "k"))
    return rows.select(F.col("sender_domain").alias("domain"), (10 * F.col("k")).alias("pref"), F.format_string("mx%d.%s", "k", "sender_domain").alias("host"), ip.alias("ip"))


def rbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = mail(spark, sf_dir).select("src_no").distinct()
    zone = lambda each, net, name: numbers.where(F.col("src_no") % each == 0).select(F.format_string(f"10.{net}.%d.1", "src_no").alias("ip"), F.lit(name).alias("zone"))
    return zone(7, 0, "zen.example").unionByName(zone(8, 1, "mx.example")).unionByName(zone(14, 0, "bl.example"))


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of three instances, two rules each; made of the numbers of sources that there are."""
    instance = (F.col("src_no") % 3).cast("string")
    numbers = mail(spark, sf_dir).select(instance.alias("instance")).distinct()
    rows = numbers.withColumn("r", F.explode(F.array(F.lit("max"), F.lit("scan"))))
    return rows.select(
        "instance",
        F.concat(F.lit("inst-"), "instance").alias("instance_name"),
        F.concat(F.lit("cf"), "instance").alias("content_filter"),
        F.concat(F.lit("filter "), "instance").alias("content_filter_name"),
        F.col("r").alias("rule"),
        F.concat("r", F.lit("-"), "instance").alias("value"),
    )


def gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gateway log from events: message_num, accepted, error, path, bytes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    bad = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("message_num"),
        (~bad).alias("accepted"),
        F.when(bad & (F.col("event_id") % 3 == 0), "script failed").alias("error"),
        F.when(F.col("user_id") % 2 == 0, "smtp").otherwise("rpc").alias("path"),
        F.floor("value").cast("long").alias("bytes"),
    )


#: The same tables in SQL.
MAIL_SQL = """mail AS (
SELECT d.doc_id AS message_num,
       CASE WHEN d.doc_id % 10 = 0 THEN 'u' || d.doc_id || '@company.com' ELSE 'u' || d.doc_id || '@' || d.source || '.' || d.lang || '.example.com' END AS sender,
       'inbox@company.com' AS recipient, trim(split_part(d.text, chr(10), 1)) AS subject, d.text AS body,
       CASE WHEN l.toxic = 1 THEN 8.5 WHEN l.quality = 0 THEN 6.0 ELSE 0.0 END::DOUBLE AS spam_score,
       CASE WHEN d.doc_id % 10 = 0 THEN 'company.com' ELSE d.source || '.' || d.lang || '.example.com' END AS sender_domain,
       CAST(substr(d.source, 4) AS INTEGER) AS src_no
FROM documents d LEFT JOIN labels l USING (doc_id))"""
DNS_SQL = "dns AS (SELECT DISTINCT sender_domain AS domain, '10.0.' || src_no || '.1' AS ip FROM mail WHERE src_no % 5 <> 0 AND sender_domain <> 'company.com')"
MX_SQL = """mx AS (
SELECT DISTINCT sender_domain AS domain, 10 * p.k AS pref, 'mx' || p.k || '.' || sender_domain AS host,
       CASE WHEN p.k = 2 AND src_no % 4 = 0 THEN 'fd00::' || src_no ELSE '10.1.' || src_no || '.' || p.k END AS ip
FROM mail, (SELECT unnest([1, 2]) AS k) p WHERE src_no % 3 <> 0 AND sender_domain <> 'company.com')"""
RBL_SQL = """rbl AS (
SELECT DISTINCT '10.0.' || src_no || '.1' AS ip, 'zen.example' AS zone FROM mail WHERE src_no % 7 = 0
UNION ALL SELECT DISTINCT '10.1.' || src_no || '.1', 'mx.example' FROM mail WHERE src_no % 8 = 0
UNION ALL SELECT DISTINCT '10.0.' || src_no || '.1', 'bl.example' FROM mail WHERE src_no % 14 = 0)"""
GATEWAY_SQL = """gateway AS (
SELECT event_id AS message_num, event_type <> 'error' AS accepted, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'script failed' END AS error,
       CASE WHEN user_id % 2 = 0 THEN 'smtp' ELSE 'rpc' END AS path, CAST(floor(value) AS BIGINT) AS bytes FROM events)"""
