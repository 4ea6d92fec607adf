"""JSON inbox rows to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import sender_domain
from ..schema import INBOX, text_or_empty
from .messages import from_columns
from .parse import header_entries, headers_map, values_of


def inbox_messages(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages from inbox rows. From and Subject are set first and overwritten by raw headers of these names (the last one wins);
    the body is the plain one, or the HTML one where that is empty."""
    sender, subject = text_or_empty(F.col("sender")), text_or_empty(F.col("subject"))
    own = F.array(F.struct(F.lit("From").alias("k"), sender.alias("v")), F.struct(F.lit("Subject").alias("k"), subject.alias("v")))
    rows = rows.withColumn("_entries", F.concat(own, header_entries(text_or_empty(F.col("raw_headers")), canonical=False)))
    mapping = {
        "headers": headers_map(F.col("_entries"), last=True),
        "header_block": F.col("raw_headers"),
        "body": F.coalesce(F.nullif(F.col("body_plain"), F.lit("")), F.col("body_html")),
        "mime_type": F.lit("text/plain"),
        "spam_score": F.col("spam_score"),
        "sender": sender,
        "sender_domain": sender_domain(sender),
        "received_headers": values_of(F.col("_entries"), "Received"),
    }
    return from_columns(rows, mapping, keep)


def read_inbox_json(spark: SparkSession, path: str, stream: bool = False, multi_line: bool = False, max_files: int | None = None) -> DataFrame:
    """Messages from JSON files (one row a line, or one array a file with ``multi_line``). A text that is not a JSON string reads as empty, and a
    score that is not a number as 0; a line that is no JSON is an empty message."""
    kinds = T.StructType([T.StructField(f.name, T.VariantType()) for f in INBOX])
    reader = (spark.readStream if stream else spark.read).schema(kinds).option("multiLine", multi_line)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(path)
    return inbox_messages(rows.select(*[_typed(f).alias(f.name) for f in INBOX]))


def _typed(field: T.StructField) -> Column:
    """The value of a variant column where JSON had this type, else null."""
    value = F.col(field.name)
    text = F.schema_of_variant(value) == "STRING"
    if field.dataType == T.StringType():
        return F.when(text, F.try_variant_get(value, "$", "string"))
    return F.when(~text & (F.schema_of_variant(value) != "BOOLEAN"), F.try_variant_get(value, "$", "double"))
