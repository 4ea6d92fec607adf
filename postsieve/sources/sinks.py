"""Result and report sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.verdicts import KINDS, disposition
from ..schema import RESULT


def result_rows(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a result: message_num, from, subject, actions, logs, modified_headers, error."""
    header = lambda n: F.coalesce(F.try_element_at("headers", F.lit(n)), F.lit(""))
    made = {"from": header("From"), "subject": header("Subject")}
    return results.select(*[(made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in RESULT], *keep)


def write_results(results: DataFrame, path: str, partition_by: str | None = "disposition", fmt: str = "parquet", checkpoint: str | None = None, mode: str = "append", run: str | None = None):
    """Write results, by disposition unless told otherwise. A stream needs a ``checkpoint`` folder and gives its query, which writes all
    that is available and ends.

    ``run`` names a run of a job (letters, digits, dots, hyphens): its rows are the folder run=... of the table, which is replaced as a whole, so a job that is repeated
    leaves its rows once, whatever an earlier attempt had written. Each batch of a stream is such a run of its own, ``run`` and its number.
    """
    rows = disposition(results) if partition_by == "disposition" and "disposition" not in results.columns else results
    if run is not None:
        if not re.fullmatch(r"[A-Za-z0-9.-]+", run):
            raise ValueError(f"not a name of a run: {run!r}")
        if rows.isStreaming:
            again = lambda batch, n: write_results(batch, path, partition_by, fmt, run=f"{run}-{n}")
            return rows.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        path, mode = f"{path}/run={run}", "overwrite"
    writer = rows.writeStream if rows.isStreaming else rows.write
    writer = writer.partitionBy(partition_by) if partition_by else writer
    if rows.isStreaming:
        return writer.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    # a run is replaced as a whole, whatever the session says of partitions
    return writer.format(fmt).mode(mode).option("partitionOverwriteMode", "static").save(path)


def report_rows(results: DataFrame) -> DataFrame:
    """Result rows in which empty logs, header edits and errors are null, which JSON leaves out."""
    rows = result_rows(results)
    logs, edits = F.when(F.size("logs") > 0, F.col("logs")), F.when(F.size(F.map_keys("modified_headers")) > 0, F.col("modified_headers"))
    return rows.withColumns({"logs": logs, "modified_headers": edits, "error": F.nullif(F.col("error"), F.lit(""))})


def write_report(results: DataFrame, path: str) -> DataFrame:
    """Write path/messages (JSON lines) and path/summary (one row), and give the summary back: total_processed, succeeded (without an error) and
    kinds (map of kind of action to the number of messages that have it). All of it is counted while the messages are written, in one pass over ``results``."""
    spark, seen = results.sparkSession, Observation()
    kinds = F.array_distinct(F.transform("actions", lambda a: F.substring_index(a, ":", 1)))
    counts = [F.count_if(F.array_contains("kinds_", k)).alias(k) for k in KINDS]
    rows = report_rows(results).withColumn("kinds_", kinds)
    rows = rows.observe(seen, F.count("*").alias("total_processed"), F.count_if(F.col("error").isNull()).alias("succeeded"), *counts).drop("kinds_")
    rows.write.mode("overwrite").json(f"{path}/messages")
    found = seen.get
    row = (found["total_processed"], found["succeeded"], {k: found[k] for k in KINDS if found[k]})
    summary = spark.createDataFrame([row], "total_processed long, succeeded long, kinds map<string,long>")
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary
