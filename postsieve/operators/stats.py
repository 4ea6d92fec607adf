"""Counts over a corpus or a stream of results. Every aggregate is combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .verdicts import route_actions


def action_counts(results: DataFrame) -> DataFrame:
    """(action, n) for each full action string."""
    return results.select(F.explode("actions").alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def action_kind_counts(results: DataFrame, key: str = "message_num") -> DataFrame:
    """(kind, n_actions, n_messages). Messages are counted once for each kind: kinds are made distinct within a message, so nothing is shuffled but counts."""
    kinds = F.transform("actions", lambda a: F.substring_index(a, ":", 1))
    each = results.select(F.explode(F.array_distinct(kinds)).alias("kind"), kinds.alias("kinds"))
    each = each.select("kind", F.size(F.filter("kinds", lambda k: k == F.col("kind"))).alias("n"))
    return each.groupBy("kind").agg(F.sum("n").cast("long").alias("n_actions"), F.count("*").alias("n_messages"))


def gateway_stats(results: DataFrame, path_col: str = "path", bytes_col: str = "bytes") -> DataFrame:
    """One row: processed, accepted, rejected, bytes, from accepted, error, path (smtp or rpc) and bytes.

    Messages with an error count as rejected on the SMTP path and not at all on the RPC path, which never adds bytes.
    """
    error = F.col("error").isNotNull() if "error" in results.columns else F.lit(False)
    counted = (F.col(path_col) == "smtp") | ~error
    good = counted & ~error & F.col("accepted")
    return results.agg(
        F.count_if(counted).alias("processed"),
        F.count_if(good).alias("accepted"),
        F.count_if(counted & ~good).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col(path_col) == "smtp", F.col(bytes_col))), F.lit(0)).cast("long").alias("bytes"),
    )


def reason_counts(results: DataFrame) -> DataFrame:
    """(accepted, reason, n)."""
    return results.groupBy("accepted", "reason").agg(F.count("*").alias("n"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: total and succeeded (without an error)."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"))
