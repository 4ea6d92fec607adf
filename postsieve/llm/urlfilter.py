"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join.

Two kinds of entries are listed: canonical URLs, and rules (host and path), which fit a host, its subdomains and every path
that starts with theirs. A URL is looked up under its canonical form and under each host suffix and path prefix that a
rule could have. Most keys end at the filter; the rest meet the list in a join on the key itself, which removes false positives.

The filter has blocks of eight 32-bit words, and a key sets one bit of each word of one block. Its size is known from the
number of entries before it is built. It is broadcast within MOST_BLOCKS; the blocks of a longer list meet the keys in a join by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, packed, saved, unpacked

#: Entries for each block of 256 bits (one false positive in several thousand), and the blocks that may be broadcast.
KEYS_PER_BLOCK, MOST_BLOCKS = 12, 1 << 17
#: List entries that may be broadcast to the exact join.
BROADCAST_ENTRIES = 10_000
# Odd multipliers that choose the bit in each of the eight words of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without slashes at its end, and the sorted query without tracking parameters; null without ://."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    form = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), tail)
    return F.when(url.contains("://"), form)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    low = F.xxhash64(key, F.lit("bits")).bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in SALTS]


def bloom_filter(keys: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """(block, w0 .. w7) of the filter of ``keys`` (key), and its number of blocks."""
    blocks = max(1, -(-entries // KEYS_PER_BLOCK))
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words), blocks


def possible(lookups: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``lookups`` (key, ...) whose key may be listed. A filter of more than MOST_BLOCKS blocks is joined by a shuffle."""
    inside = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        inside = inside & (F.col(f"w{i}").bitwiseAND(b) != 0)
    probed = lookups.withColumn("block", _block(F.col("key"), blocks)).join(hinted(bloom, blocks, MOST_BLOCKS), "block")
    return probed.where(inside).drop("block", *[f"w{i}" for i in range(8)])


def filter_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow", listed_verdict: str = "block") -> DataFrame:
    """``urls`` with host, path, rule, verdict and listed (boolean).

    ``rules`` has host, path, verdict; ``listed`` has url. The longest rule that fits decides (of equally long ones the first
    by code point; a rule given twice with two verdicts blocks). Without a rule, a URL whose canonical form is that of a listed URL gets
    ``listed_verdict``, any other ``default``. A null URL or one without :// has an empty host and path, fits no
    rule and is not listed. Each distinct URL is judged once; a URL that very many rows share is met in a join that
    Spark may split. Columns of ``urls`` with the new names are replaced; others stay. Empty tables are allowed.
    """
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out, as the list may be short but the work for each URL is not
    distinct = saved(urls.select(F.col(url_col).alias("url_")).where("url_ is not null").distinct().repartition(parts, "url_"), "url-distinct")
    known = distinct.select("url_", host_of(F.col("url_")).alias("host_"), path_of(F.col("url_")).alias("path_"), canonical(F.col("url_")).alias("form_"))

    rules = rules.select(F.concat("host", "path").alias("rule_"), "host", "path", "verdict").where("rule_ is not null")
    rule_keys = rules.groupBy(F.concat(F.lit("r"), "host", F.lit("\x1f"), "path").alias("key")).agg(F.min("rule_").alias("rule_"), F.max("verdict").alias("rule_verdict_"))
    form_keys = listed.select(F.concat(F.lit("u"), canonical(F.col("url"))).alias("key")).where("key is not null").distinct()
    entries = saved(rule_keys.unionByName(form_keys, allowMissingColumns=True), "url-list")
    count = entries.count()
    # what shapes rules have: a few numbers, so that a URL is looked up only under keys that a rule could have
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()

    labels = F.split("host_", r"\.")
    at_most = F.lit(shape.labels or 0)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), at_most)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    suffixes = F.when((at_most > 0) & (F.col("host_") != ""), suffixes).otherwise(F.array().cast("array<string>"))
    lengths = F.filter(F.lit(sorted(shape.lengths)) if shape.lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path_"))
    heads = F.transform(lengths, lambda n: F.substr("path_", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(F.lit("r"), s, F.lit("\x1f"), h))))
    keys = F.array_distinct(F.concat(pairs, F.array(F.concat(F.lit("u"), F.col("form_")))))
    lookups = known.select("url_", F.explode(keys).alias("key")).where("key is not null")
    lookups = possible(lookups, *bloom_filter(entries, count))
    exact = lookups.join(F.broadcast(entries) if count <= BROADCAST_ENTRIES else entries, "key")
    hits = exact.groupBy("url_").agg(
        F.min(F.when(F.col("rule_").isNotNull(), F.struct((-F.length("rule_")).alias("less"), "rule_", "rule_verdict_"))).alias("best"),
        F.max(F.col("rule_").isNull()).alias("listed_"),
    )
    rows = urls.select(packed(urls), F.col(f"`{url_col}`").alias("own_url_"))
    out = rows.join(hits, F.col("own_url_") == F.col("url_"), "left")
    otherwise = F.when(F.coalesce("listed_", F.lit(False)), F.lit(listed_verdict)).otherwise(F.lit(default))
    return out.select(
        *unpacked(urls.columns, ("host", "path", "rule", "verdict", "listed")),
        host_of(F.col("own_url_")).alias("host"),
        path_of(F.col("own_url_")).alias("path"),
        F.col("best.rule_").alias("rule"),
        F.coalesce("best.rule_verdict_", otherwise).alias("verdict"),
        F.coalesce("listed_", F.lit(False)).alias("listed"),
    )
