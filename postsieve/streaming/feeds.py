"""Policies over unbounded feeds. Progress is kept in the checkpoint, so each message is handled once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import Policy, apply_policy
from ..operators.stats import gateway_stats
from ..operators.verdicts import verdict
from ..schema import fresh
from ..sources.inbox import read_inbox_json


def process_stream(messages: DataFrame, policy: Policy, mode: str = "last") -> DataFrame:
    """One result with a verdict for each message of a stream (or table). Stateless; order holds within a source partition only."""
    return verdict(apply_policy(messages, policy), mode)


def monitor(spark: SparkSession, path: str, policy: Policy, out: str, checkpoint: str, interval: str | None = "5 seconds", max_files: int | None = None) -> StreamingQuery:
    """Watch a folder of JSON inbox files and write the results of new messages as Parquet to ``out``.

    The first batch takes what is there. With ``interval`` None all that is available is handled and the query ends. Rows that
    are no JSON become empty messages; files that cannot be read are passed over.
    """
    results = process_stream(read_inbox_json(spark, path, stream=True, max_files=max_files), policy)
    writer = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def running_stats(results: DataFrame, path: str | Column = "rpc") -> DataFrame:
    """Counters since the start: processed, accepted, rejected, bytes. For complete or update mode.

    ``path`` says by which path messages came, smtp or rpc: a text for all of them or a column. As in ``gateway_stats``, only the SMTP path
    counts messages with an error, as rejected, and bytes.
    """
    path_, bytes_ = fresh(results.columns, "path_", "bytes_")
    rows = results.withColumns({path_: path if isinstance(path, Column) else F.lit(path), bytes_: F.octet_length("body").cast("long")})
    return gateway_stats(rows, path_, bytes_)


COUNTERS = ("processed", "accepted", "rejected", "bytes")


def store_stats(results: DataFrame, store: str, checkpoint: str, path: str | Column = "rpc", interval: str | None = None) -> StreamingQuery:
    """Keep the counters of ``running_stats`` as a table at ``store``: for each batch of the stream, what has been counted up to its end.

    A batch adds what it counts to the row of the batch before and replaces its own row, so a batch that is handled again after a failure counts once. With
    ``interval`` None all that is available is handled and the query ends.
    """

    def add(batch: DataFrame, n: int) -> None:
        # a batch with nothing but skipped rows counts 0
        now = running_stats(batch, path)
        if n:
            now = now.unionByName(batch.sparkSession.read.parquet(f"{store}/batch={n - 1}")).agg(*[F.sum(c).alias(c) for c in COUNTERS])
        now.write.mode("overwrite").parquet(f"{store}/batch={n}")

    writer = results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stored_stats(spark: SparkSession, store: str) -> DataFrame:
    """The counters at ``store`` up to the last batch: one row."""
    return spark.read.parquet(store).agg(*[F.max_by(c, "batch").alias(c) for c in COUNTERS])


def store_snapshot(snapshot: DataFrame, path: str, version: int) -> None:
    """Keep a version of a lookup table under ``path``; a version that is stored again is replaced."""
    snapshot.write.mode("overwrite").parquet(f"{path}/version={version}")


def _versions(spark: SparkSession, snapshots: Mapping[str, str], kept: str) -> dict[str, int]:
    """The newest version of each snapshot, or those that were noted at ``kept`` when the batch was handled first."""
    try:
        return {r.name: r.version for r in spark.read.schema("name string, version long").parquet(kept).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    newest = {name: spark.read.parquet(path).agg(F.max("version")).first()[0] for name, path in snapshots.items()}
    spark.createDataFrame(list(newest.items()), "name string, version long").coalesce(1).write.mode("overwrite").parquet(kept)
    return newest


def enriched_stream(messages: DataFrame, snapshots: Mapping[str, str], use: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Look the messages of a stream up in snapshots that change while it runs, and write what ``use`` makes of each batch as Parquet to ``out``/rows.

    ``snapshots`` names the folders of ``store_snapshot``. Each batch reads their newest versions and passes them to ``use`` (batch, tables by name), so lookups are counted and
    broadcast anew for each batch. The versions are noted under ``out``/versions first and the rows of a batch replace those of an earlier attempt at it, so a batch that is
    handled again gives the same rows. With ``interval`` None all that is available is handled and the query ends.
    """

    def handle(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, snapshots, f"{out}/versions/batch={n}")
        tables = {name: spark.read.parquet(f"{path}/version={versions[name]}") for name, path in snapshots.items()}
        use(batch, tables).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
