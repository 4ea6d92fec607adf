"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Words in a shingle and the similarity from which two texts count as near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: Rows of texts in a batch for Python, and their bytes (a single row may have more).
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names. Where that is unset, as in tests, a new local folder
    is set for the session; on a cluster it has to be set, as executors do not share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/postsieve/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: executors that are lost later cannot make Spark compute ``df`` again, and
    the table can be read several times at the price of one.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of BATCH_ROWS rows and BATCH_BYTES bytes, unless the session asks for less. Spark's usual 10,000 rows
    of long texts would be held several times over, in the executor's Arrow buffers and in each worker. The setting stays for the session."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(str(spark.conf.get(name)).removesuffix("b")) <= most:
            spark.conf.set(name, str(most))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """As ``bounded_batches``, for what is computed inside of the block only."""
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    was = [spark.conf.get(n) for n in names]
    bounded_batches(spark)
    try:
        yield
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.set(n, v)


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hinted(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the stated bound, else unchanged."""
    return F.broadcast(df) if rows <= most else df


def packed(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The columns (all by default) as one struct named row_, so none of their names can clash with those that an operator makes."""
    return F.struct(*[F.col(f"`{c}`") for c in (columns if columns is not None else df.columns)]).alias("row_")


def unpacked(columns: Sequence[str], made: Sequence[str] = ()) -> list[Column]:
    """The columns of row_ again, without those that are made anew."""
    return [F.col(f"row_.`{c}`").alias(c) for c in columns if c not in made]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
