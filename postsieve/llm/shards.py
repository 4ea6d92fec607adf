"""Sharding over fixed virtual slots. Only DataFrame functions: no Python runs on the executors.

Records are hashed into SLOTS slots, bytes are summed for each slot, and a map from slots to shards is kept
as a table with a version. Adding a shard edits the map: some slots of each shard move to the new one and no other slot moves.
The number of slots is fixed, so the map never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import packed, scratch, unpacked

#: Three hex digits of a hash, and one more for the pieces of a slot in which its records are numbered.
SLOTS, PIECES = 4096, 16


def slot_of(*keys: Column) -> Column:
    """The virtual slot of a record, 0 to SLOTS - 1, from the MD5 of its key columns; a null key counts as a key of its own."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("int")


def piece_of(*keys: Column) -> Column:
    """The piece of its slot that a record is in, 0 to PIECES - 1; independent of the slot."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text), 4, 1), 16, 10).cast("int")


def slot_bytes(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    """(slot, bytes) for each of the SLOTS slots, empty ones included."""
    spark = records.sparkSession
    used = records.groupBy(F.col(slot).alias("slot")).agg(F.sum(size).cast("long").alias("bytes"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return every.join(used, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def slot_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map (version, slot, shard, bytes): slots from large to small, each to the shard with the fewest bytes so far.

    ``sizes`` has SLOTS rows whatever the data, which are put in one array to be dealt in this order.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def deal(state: Column, item: Column) -> Column:
        load = state["load"]
        lightest = F.array_position(load, F.array_min(load)).cast("int") - 1
        return F.struct(
            F.transform(load, lambda x, i: F.when(i == lightest, x - item["less"]).otherwise(x)).alias("load"),
            F.concat(state["to"], F.array(lightest)).alias("to"),
        )

    dealt = sizes.agg(order.alias("items")).select("items", F.aggregate("items", start, deal)["to"].alias("to"))
    pairs = dealt.select(F.explode(F.arrays_zip("items", "to")).alias("x"))
    return pairs.select(F.lit(0).alias("version"), F.col("x.items.slot").alias("slot"), F.col("x.to").alias("shard"), (-F.col("x.items.less")).alias("bytes"))


def grown(mapping: DataFrame) -> DataFrame:
    """The next version of the map with one shard more. Each shard gives up slots, in an order that depends on nothing
    but the slot, while what it has given stays within what it holds above the new mean. Empty shards have no rows here and give none."""
    total = mapping.agg(F.sum("bytes").alias("total"), (F.max("shard") + 1).alias("shards"))
    by_shard = Window.partitionBy("shard")
    given = F.sum("bytes").over(by_shard.orderBy(F.md5(F.col("slot").cast("string")), "slot").rowsBetween(Window.unboundedPreceding, 0))
    held = F.sum("bytes").over(by_shard)
    moved = given <= held - F.col("total") / (F.col("shards") + 1)
    return mapping.crossJoin(F.broadcast(total)).select((F.col("version") + 1).alias("version"), "slot", F.when(moved, F.col("shards")).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def store_map(mapping: DataFrame, path: str) -> None:
    """Add a version of the map to the table at ``path``; versions that are there stay."""
    mapping.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map from the table at ``path``, the latest by default."""
    kept = spark.read.parquet(path)
    if version is None:
        version = kept.agg(F.max("version")).first()[0]
    return kept.where(F.col("version") == version).select("version", "slot", "shard", "bytes")


def stored_map(records: DataFrame, keys: list[str], size: Column, shards: int = 8, path: str | None = None) -> tuple[DataFrame, str]:
    """Version 0 of the map for ``records``, written to a table at ``path`` and read back, and the path. Later runs load the map from there, or add grown versions to it;
    without a path it is a new table in the shared folder, for this run alone."""
    own = [F.col(f"`{k}`") for k in keys]
    sized = records.select(F.coalesce(size, F.lit(0)).cast("long").alias("size"), slot_of(*own).alias("vslot"))
    path = path or scratch(records.sparkSession, "shard-map")
    store_map(slot_map(slot_bytes(sized), shards), path)
    return load_map(records.sparkSession, path, 0), path


def shard_by_slots(records: DataFrame, keys: list[str], size: Column, shards: int = 8, mapping: DataFrame | None = None) -> DataFrame:
    """``records`` with the columns size (long), vslot, shard (int) and slot (long): the place in the shard, from 0 without gaps.

    The slot comes from all ``keys``, so one hot value of one key does not fill a slot. Rows that are equal in all keys can't be told apart and share a slot, so shards are near equal
    only as long as no row is repeated so often that it outweighs a shard's share. The shard comes from
    ``mapping``, or from a new map with near-equal bytes. Places are numbered piece by piece: counts of the PIECES pieces of each slot give
    each piece's first place, and rows are numbered within their piece only, by their keys. Rows with equal keys are
    interchangeable and get places in any order. Null keys and sizes are allowed (a null size counts as 0). Columns
    named like the new ones are replaced. An empty table gives no rows.
    """
    made = ("size", "vslot", "shard", "slot")
    own = {f"k{i}_": F.col(f"`{k}`") for i, k in enumerate(keys)}
    sized = records.select(packed(records), *[c.alias(k) for k, c in own.items()], F.coalesce(size, F.lit(0)).cast("long").alias("size"), slot_of(*own.values()).alias("vslot"), piece_of(*own.values()).alias("piece_"))
    if mapping is None:
        mapping = slot_map(slot_bytes(sized), shards)
    counts = sized.groupBy("vslot", "piece_").agg(F.count("*").alias("rows_"))
    mapping = mapping.select(F.col("slot").alias("vslot"), "shard").join(counts, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "piece_").rowsBetween(Window.unboundedPreceding, -1)
    mapping = mapping.select("vslot", "piece_", "shard", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("first_"))
    within = Window.partitionBy("vslot", "piece_").orderBy(*own)
    placed = sized.withColumn("place_", F.row_number().over(within) - 1).join(F.broadcast(mapping), ["vslot", "piece_"])
    return placed.select(*unpacked(records.columns, made), "size", "vslot", "shard", (F.col("first_") + F.col("place_")).cast("long").alias("slot"))
