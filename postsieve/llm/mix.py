"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources get a share of the mix by weight; a target stops at ``most`` times its source and the
excess is shared again by weight. Units: the records of a source are hashed into blocks; a unit is one reading of one block. A
target is met by whole readings of all blocks, then by whole blocks in a seeded order, then by records of one last block.
Splitting tree: the exact numbers of units of all sources are split in two, again and again, by draws from a
multivariate hypergeometric distribution, until each output shard has its own numbers. Units of a source, in a seeded
order, then go to the shards by these numbers, so shards draw disjoint units; each shard shuffles its own rows.

All this is worked out on a table of groups (source, id, size, hash of the columns, number of rows): texts are read once to make it and once
to give each row its decision, and are in no window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hinted, packed, saved, unpacked

#: A block has about this many records at least, so that the last one can be filled closely, and a source at most so many blocks.
BLOCK_RECORDS, MOST_BLOCKS = 64, 1 << 15
#: Rows of decisions (for blocks, or for records of last blocks) that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Sources are few, as each has a weight of its own: their table is read by the driver and must not have more rows than this.
MOST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target. Sources by code point, null last, take the weights in turn.

    Sharing again until none is above its limit ends at target = min(limit, level * weight) with one common level. Sources
    reach their limit in the order of limit / weight, so the level follows from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", turn).withColumn("limit_", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("limit_") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rows = rows.withColumns(
        {
            "goal_": F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("limit_").over(everything)),
            "below_": F.coalesce(F.sum("limit_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # the level that would hold if this source and all after it were free; the first free one gives the true level, later ones less
    level = (F.col("goal_") - F.col("below_")) / F.col("weights_")
    rows = rows.withColumn("level_", F.when(level * F.col("weight") <= F.col("limit_"), level))
    rows = rows.withColumn("level_", F.max("level_").over(everything))
    target = F.when(F.col("level_").isNull(), F.col("limit_")).otherwise(F.least("limit_", F.col("level_") * F.col("weight")))
    return rows.select(*sizes.columns, "weight", target.alias("target"))


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards x sources) numbers of units: row sums differ by one at most, column sums are the quotas exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(own: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid, total = (lo + hi) // 2, int(own.sum())
        rng = np.random.default_rng([seed, lo, hi])
        part = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(own, part, method="marginals") if part else np.zeros_like(own)
        split(left, lo, mid)
        split(own - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    shards: int = 8,
    seed: int = 17,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row for each record of ``docs``: its ``columns`` (all by default), mix_size, source_size, source_target,
    mix_copies (how often the mix reads it) and mix_shards (array<int>: the output shard of each reading).

    ``mixed_rows`` turns this into the rows of the mix. The readings of a source come near its target (by less than half of the smallest record left unread in its last block); none exceeds ``most``.
    The order within a source depends on the seed, id, size and a hash of the columns only, so reruns agree; rows in which these are
    equal are the same row several times. A null size counts as 0; null is a source of its own. A source
    without words is read once and has the target 0. Columns with the new names are replaced; columns have to be of types that Spark can hash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    columns = list(columns if columns is not None else docs.columns)
    coin = lambda *more: F.xxhash64(F.lit(seed), *more)
    key = ["source_", "id_", "mix_size", "content_"]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0).cast("long")
    own = (F.col(source_col).alias("source_"), F.col(id_col).alias("id_"), F.coalesce(size, F.lit(0)).cast("long").alias("mix_size"), content.alias("content_"))
    groups = saved(docs.select(*own).groupBy(*key).agg(F.count("*").alias("rows_")), "mix-groups")
    words = F.col("mix_size") * F.col("rows_")
    sizes = groups.groupBy(F.col("source_").alias("source")).agg(F.sum(words).alias("source_size"), F.sum("rows_").alias("records"))
    targets = source_targets(sizes, weights, share, most)
    listed = targets.orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    schema = "number_ int, of_ string, blocks_ int, source_size long, source_target double, full_ int, rest_ double"
    plan = []
    for n, r in enumerate(listed):
        full = int(r.target // r.source_size) if r.source_size else 1
        blocks = min(MOST_BLOCKS, 1 << max(0, (r.records // BLOCK_RECORDS).bit_length() - 1))
        plan.append((n, r.source, blocks, r.source_size, float(r.target), full, float(r.target - full * r.source_size)))
    sources = F.broadcast(spark.createDataFrame(plan, schema))
    block = F.pmod(coin(F.lit("block"), "id_", "mix_size", "content_"), F.col("blocks_")).cast("int").alias("block_")

    # blocks of each source in their seeded order, with the words before them: whole, last or no part of the reading that is not full
    by_source = Window.partitionBy("number_").orderBy(coin(F.lit("order"), "block_"), "block_")
    placed = groups.join(sources, F.col("source_").eqNullSafe(F.col("of_"))).select(*key, "rows_", block, "number_", "full_", "rest_", "source_size", "source_target")
    ranked = placed.groupBy("number_", "full_", "rest_", "source_size", "source_target", "block_").agg(F.sum(words).alias("words_"))
    ranked = ranked.withColumn("before_", F.coalesce(F.sum("words_").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = (F.col("rest_") > 0) & (F.col("before_") < F.col("rest_"))
    more = F.when(inside & (F.col("before_") + F.col("words_") <= F.col("rest_")), 2).when(inside, 1).otherwise(0)
    ranked = ranked.withColumn("more_", more).withColumn("left_", F.col("rest_") - F.col("before_"))
    # units: one for each full reading of a block and one for the part; numbered within the source
    ranked = ranked.withColumn("units_", F.col("full_") + F.when(F.col("more_") > 0, 1).otherwise(0))
    ranked = saved(ranked.withColumn("unit_", F.coalesce(F.sum("units_").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")), "mix-blocks")

    counts = {r.number_: r.units for r in ranked.groupBy("number_").agg(F.sum("units_").cast("long").alias("units")).collect()}
    quotas = split_quotas([counts.get(n, 0) for n in range(len(plan))], shards, seed) if plan else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(quotas, axis=0)
    dealt = F.broadcast(spark.createDataFrame([(n, [int(x) for x in ends[:, n]]) for n in range(len(plan))], "number_ int, ends_ array<long>"))
    shard = lambda unit: F.size(F.filter("ends_", lambda e: e <= unit)).cast("int")
    wanted = F.when(F.col("units_") > 0, F.transform(F.sequence(F.lit(0), F.col("units_") - 1), lambda i: shard(F.col("unit_") + i))).otherwise(F.array().cast("array<int>"))
    ranked = ranked.join(dealt, "number_").select("number_", "block_", "full_", "more_", "left_", "source_size", "source_target", wanted.alias("shards_"))
    n_ranked = sum(p[2] for p in plan)

    # how many rows of each group are taken of the blocks that are read in part
    part = _filled(placed.select(*key, "rows_", "number_", "block_").join(hinted(ranked.where("more_ = 1").select("number_", "block_", "left_"), n_ranked, BROADCAST_ROWS), ["number_", "block_"]), coin)
    part = saved(part.select(*[F.col(k).alias(f"p_{k}") for k in key], "rows_", "took_"), "mix-parts")
    n_part = part.count()

    rows = docs.select(packed(docs, columns), *own).join(sources, F.col("source_").eqNullSafe(F.col("of_"))).select("row_", *key, "number_", block)
    joined = rows.join(hinted(ranked, n_ranked, BROADCAST_ROWS), ["number_", "block_"])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    joined = joined.join(hinted(part, n_part, BROADCAST_ROWS), same, "left")
    split = F.coalesce((F.col("took_") > 0) & (F.col("took_") < F.col("rows_")), F.lit(False))
    made = ["mix_size", "source_size", "source_target", "full_", "shards_"]
    whole = joined.where(~split).select("row_", *made, ((F.col("more_") == 2) | (F.coalesce("took_", F.lit(0)) > 0)).cast("int").alias("once_"))
    # the rows of a group are one row several times: it is written that often again, so that they need not be numbered
    parted = joined.where(split).groupBy(*key, "rows_", "took_", *[m for m in made if m != "mix_size"]).agg(F.any_value("row_").alias("row_"))
    again = lambda n, once: F.array_repeat(F.lit(once), n.cast("int"))
    parted = parted.select("row_", *made, F.explode(F.concat(again(F.col("took_"), 1), again(F.col("rows_") - F.col("took_"), 0))).alias("once_"))
    rows = whole.unionByName(parted).withColumn("mix_copies", F.col("full_") + F.col("once_"))
    kept = unpacked(columns, ("mix_size", "source_size", "source_target", "mix_copies", "mix_shards"))
    return rows.select(*kept, "mix_size", "source_size", "source_target", "mix_copies", F.slice("shards_", F.lit(1), F.col("mix_copies")).alias("mix_shards"))


def _filled(part: DataFrame, coin: Callable[..., Column]) -> DataFrame:
    """The groups of blocks that are read in part with took_: how many of their rows_ are taken, so that the words come near left_.

    First the larger half of a block's groups, in a seeded order while they fit; then, largest first, the ones that still fit, so small ones close
    the gap; at last one more if that comes nearer."""
    block = Window.partitionBy("number_", "block_")
    seeded = [coin(F.lit("row"), "id_", "mix_size", "content_"), "id_", "content_"]
    taken = F.sum(F.col("mix_size") * F.col("took_")).over(block)
    part = part.withColumn("took_", F.lit(0).cast("long")).withColumn("large_", F.percent_rank().over(block.orderBy(F.col("mix_size").desc())) < 0.5)
    for turn in range(4):
        part = part.withColumn("gap_", F.col("left_") - taken)
        fits = (F.col("mix_size") > 0) & (F.col("mix_size") <= F.col("gap_")) & (F.col("large_") if turn == 0 else F.lit(True))
        part = part.withColumn("open_", F.when(fits, F.col("rows_") - F.col("took_")).otherwise(0))
        order = block.orderBy(*(seeded if turn == 0 else [F.col("mix_size").desc(), *seeded])).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("mix_size") * F.col("open_")).over(order), F.lit(0))
        room = F.floor((F.col("gap_") - before) / F.when(F.col("mix_size") > 0, F.col("mix_size")))
        part = part.withColumn("took_", F.col("took_") + F.greatest(F.lit(0), F.least(F.coalesce(room, F.lit(0)), "open_")).cast("long"))
    part = part.withColumn("gap_", F.col("left_") - taken).withColumn("off_", F.when(F.col("took_") < F.col("rows_"), F.abs(F.col("mix_size") - F.col("gap_"))))
    nearest = (F.row_number().over(block.orderBy(F.col("off_").asc_nulls_last(), *seeded)) == 1) & F.coalesce(F.col("off_") < F.col("gap_"), F.lit(False))
    return part.withColumn("took_", F.col("took_") + nearest.cast("long"))


def mixed_rows(mix: DataFrame, columns: Sequence[str], id_col: str = "doc_id", seed: int = 17, shard_col: str | None = "mix_shard") -> DataFrame:
    """The rows of the mix: ``columns`` and, unless it is None, ``shard_col`` (which replaces a column of that name), once for each reading; dealt by
    shard and, for each shard, a piece of the seeded order, and shuffled within it. Records that the mix does not take have no row."""
    out = mix.select(packed(mix, columns), F.col(id_col).alias("id_"), F.posexplode("mix_shards").alias("reading_", "shard_"))
    order = F.xxhash64(F.lit(seed), F.lit("local"), "shard_", "reading_", "id_")
    out = out.withColumn("order_", order).repartition("shard_", F.pmod("order_", F.lit(64)))
    out = out.sortWithinPartitions("shard_", "order_")
    return out.select(*unpacked(columns, (shard_col,)), *([F.col("shard_").alias(shard_col)] if shard_col else []))
