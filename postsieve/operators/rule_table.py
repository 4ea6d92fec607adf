"""Policies as tables: thousands of keyword rules, of which the first that holds decides.

A rule holds if all of its words occur in a text. Texts are cut into words once, however many rules there are, and the words are looked up in an inverted index of
the rules: word, rules. Words are runs of ASCII letters and digits and of characters that are not ASCII, A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..schema import fresh

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of the inverted index (a word, a rule) that are handed to every task; of a larger one each task gets what its words meet.
BROADCAST_WORDS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_WORD = re.compile(WORD)


def words_of(text: Column) -> Column:
    """The distinct words of a text, as an array; empty for null."""
    # possessive: a run is taken as a whole, without a way back
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD + "+"), 0)
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def inverted_index(rules: DataFrame) -> DataFrame:
    """(word, rule_no, n_words) from ``rules`` (rule_no, words). Rules without words, or without a number, never hold and are not in it."""
    rows = rules.where("rule_no is not null").select(F.col("rule_no").cast("long").alias("rule_no"), words_of(F.col("words")).alias("words_"))
    return rows.select(F.explode("words_").alias("word"), "rule_no", F.size("words_").alias("n_words"))


def _looked_up(index: Broadcast):
    """The number of the first rule that holds for each text, with the index in memory once for each batch stream."""

    @arrow_udf("long")
    def first(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_word: dict[str, list[tuple[int, int]]] = {}
        for word, rule_no, n_words in index.value:
            by_word.setdefault(word, []).append((rule_no, n_words))
        known = by_word.keys()
        for part in parts:
            out = []
            for text in part.to_pylist():
                met: dict[int, int] = {}
                best = None
                for word in known & set(_WORD.findall((text or "").translate(_FOLD))):
                    for rule_no, n_words in by_word[word]:
                        if best is not None and rule_no >= best:
                            continue
                        met[rule_no] = met.get(rule_no, 0) + 1
                        if met[rule_no] == n_words:
                            best = rule_no
                out.append(best)
            yield pa.array(out, pa.int64())

    return first


def _joined(messages: DataFrame, index: DataFrame, text: Column, name: str) -> DataFrame:
    """The same by a join: the message side is shuffled once, to put each message, which travels as one row, together with the rules that its words met."""
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), words_of(text).alias("words"), F.monotonically_increasing_id().alias("key"))
    # one row carries the message, the others a word
    each = rows.select("key", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("word"), "row")
    each = each.withColumn("row", F.when(F.col("word").isNull(), F.col("row")))
    met = each.join(index, "word", "left").where("rule_no is not null or word is null").repartition("key")
    by_rule = met.groupBy("key", "rule_no").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("row", ignorenulls=True).alias("row"))
    best = by_rule.groupBy("key").agg(F.min(F.when(F.col("n") == F.col("n_words"), F.col("rule_no"))).alias("best"), F.first("row", ignorenulls=True).alias("row"))
    return best.select(*[F.col(f"row.`{c}`").alias(c) for c in messages.columns], F.col("best").alias(name))


def first_rule(messages: DataFrame, rules: DataFrame, text: Column | None = None, name: str = "rule_no") -> DataFrame:
    """``messages`` with the number of the first of ``rules`` (rule_no, words) that holds for a text, the body by default; null where none does.

    A rule holds if every word of ``words`` occurs in the text. Numbers are expected to be unique. An index of up to BROADCAST_WORDS rows is
    handed to the tasks, so messages are not shuffled, in batches and streams; a larger one is joined, with one shuffle of the messages, and not for streams. A null text has no words. A column of
    the same name is replaced. Empty tables are allowed.
    """
    text = F.col("body") if text is None else text
    rows = messages.drop(name)
    index = inverted_index(rules)
    few = index.limit(BROADCAST_WORDS + 1).collect()
    if len(few) <= BROADCAST_WORDS:
        spark = messages.sparkSession
        found = _looked_up(spark.sparkContext.broadcast([tuple(r) for r in few]))(text.cast("string"))
        return rows.withColumn(name, found)
    return _joined(rows, index, text.cast("string"), name)


def apply_rule_table(messages: DataFrame, rules: DataFrame, text: Column | None = None, default: str | None = "accept") -> DataFrame:
    """``messages`` with rule_no, actions, logs and modified_headers, from ``rules`` (rule_no, words, action): the action of the first rule that holds, as an action
    string; without one, ``default`` (None: no action). A message with an error emits nothing. Rule numbers are expected to be unique; of several actions of a number the first by name counts.
    """
    found = first_rule(messages, rules, text)
    number_, action_ = fresh(found.columns, "number_", "action_")
    actions = rules.groupBy(F.col("rule_no").cast("long").alias(number_)).agg(F.min("action").alias(action_))
    few = rules.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    rows = found.join(F.broadcast(actions) if few else actions, F.col("rule_no") == F.col(number_), "left")
    had_error = F.col("error").isNotNull() if "error" in messages.columns else F.lit(False)
    action = F.coalesce(F.col(action_), F.lit(default))
    emitted = F.when(had_error | action.isNull(), F.array().cast("array<string>")).otherwise(F.array(action))
    made = {"actions": emitted, "logs": F.array().cast("array<string>"), "modified_headers": F.create_map().cast("map<string,string>")}
    return rows.withColumns(made).drop(number_, action_)
