"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: any one type that has an order); component is its smallest node.

    Each round contracts the links: every node moves to its first neighbour in a random order (or stays, if it is first), the moves are
    followed once more, both ends of each link are renamed, and loops and repeated links go. So links get fewer by a factor each round, and a star is
    one round's work. The moves of the rounds are put together at the end. Nothing leaves the cluster but the question whether links are left.
    A node that very many links name is met in joins, which Spark may split, and in minima, which are combined before the shuffle.

    No links give no rows. Repeated links and loops do no harm; links with a null end are passed over.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = saved(links.select(*ends(F.col("a"), F.col("b"))).distinct(), f"{what}-links")
    loops = left.where("a = b").select(F.col("a").alias("node"))
    left = left.where("a <> b")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        moves = first.select(F.col("a").alias("node"), F.least(rank("a"), "near")["n"].alias("to"))
        hop = moves.select(F.col("node").alias("to"), F.col("to").alias("hop"))
        moves = saved(moves.join(hop, "to").select("node", F.col("hop").alias("to")), f"{what}-moves")
        rounds.append(moves)
        for end in ("a", "b"):
            left = left.join(moves.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        left = saved(left.where("a <> b").select(*ends(F.col("a"), F.col("b"))).distinct(), f"{what}-links")
    if not rounds:
        return loops.select("node", F.col("node").alias("component"))
    found = rounds.pop()
    for moves in reversed(rounds):
        onward = found.select(F.col("node").alias("to"), F.col("to").alias("end"))
        found = moves.join(onward, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    found = saved(found, f"{what}-labels")
    smallest = found.groupBy("to").agg(F.min("node").alias("component"))
    named = found.join(smallest, "to").select("node", "component")
    alone = loops.join(found, "node", "left_anti")
    return named.unionByName(alone.select("node", F.col("node").alias("component")))
