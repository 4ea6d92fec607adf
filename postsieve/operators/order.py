"""Numbering and limits in mailbox order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schema import fresh


def number_messages(rows: DataFrame, blocks: list[Column], within: str | None = "row_id", name: str = "message_num") -> DataFrame:
    """``rows`` with a 1-based number in the order of ``blocks`` and, within a block, of ``within``.

    Two passes: counts of the blocks give each its first number, and rows are numbered inside of their block, so no task
    sees more than one block's rows. A block is a file split or a file; their list, not the rows, is ordered as a whole.
    """
    keys = fresh(rows.columns, *[f"block{i}_" for i in range(len(blocks))])
    starts_, n_, before_ = [f"{k}start_" for k in keys], *fresh(rows.columns, "n_", "before_")
    keyed = rows.withColumns(dict(zip(keys, blocks, strict=True)))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias(n_))
    before = F.coalesce(F.sum(n_).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(s) for k, s in zip(keys, starts_, strict=True)], before.alias(before_))
    joined = keyed.join(starts, [F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, starts_, strict=True)])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(within if within else F.lit(1)))
    return joined.withColumn(name, (F.col(before_) + place).cast("long")).drop(*keys, *starts_, before_)


def first_messages(numbered: DataFrame, limit: int | None, name: str = "message_num") -> DataFrame:
    """The messages up to number ``limit``; all of them for 0 or None."""
    return numbered.where(F.col(name) <= limit) if limit else numbered


def concat_folders(current: DataFrame, new: DataFrame) -> DataFrame:
    """The messages of both folders with folder_rank 0 and 1, to be ordered by it."""
    return current.withColumn("folder_rank", F.lit(0)).unionByName(new.withColumn("folder_rank", F.lit(1)), allowMissingColumns=True)
