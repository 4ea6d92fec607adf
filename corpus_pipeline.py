"""A pipeline over ``documents``: five operators, each on all rows that the one before it kept.

Stages write their result as Parquet; the next one reads that. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import decontam, mix, ngramjoin, quality, shards
from postsieve.llm.common import saved, table, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, once where its row is repeated.

    A document is known by its id and its text, so different texts that share an id, or have none, are told apart.
    """
    return ngramjoin.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source to its target weight reads them, so some more than once, in the order of the mix."""
    mixed = mix.mix_sources(docs, word_count(F.col("text")))
    return mix.mixed_rows(mixed, docs.columns, shard_col=None)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard: size (bytes and 1), vslot, shard and slot. The slot map is stored first and read back."""
    text = F.coalesce("text", F.lit(""))
    keyed, keys, size = docs.withColumn("text_crc32", F.crc32(text.cast("binary"))), ["doc_id", "text_crc32"], F.octet_length(text) + 1
    mapping, _ = shards.stored_map(keyed, keys, size, 8)
    return shards.shard_by_slots(keyed, keys, size, mapping=mapping)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("sharding", sharding),
]

#: SQL cannot express the outlier test and the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{n + 1}")
    return docs
