"""Bounded breadth-first walks from many seeds at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import cut


HUB = 10_000  # links of one node that a single join key holds; those beyond are spread over further keys


def _spread(links: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """Links with a slot, and (from_id, slots) of the nodes that have more than one slot.

    The slot is a hash of the end, so the links of a node with very many spread over as many keys as
    they need, and the frontier is repeated once per slot.
    """
    counts = links.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub)
    slots = cut(counts.select("from_id", F.ceil(F.col("n") / hub).cast("int").alias("slots")))
    slot = F.pmod(F.xxhash64("to_id"), F.coalesce("slots", F.lit(1))).cast("int")
    return cut(links.join(slots, "from_id", "left").select("from_id", "to_id", slot.alias("slot"))), slots


def walk(links: DataFrame, seeds: DataFrame, max_depth: int, root_may_return: bool = False, hub: int = HUB) -> DataFrame:
    """(seed, node, depth, parent) of all nodes within ``max_depth`` steps of each seed.

    ``links`` has from_id and to_id, ``seeds`` the column seed. A node has its least depth and, of
    the nodes that reach it first, the least as parent. The seed itself has depth 0 and a null
    parent; with ``root_may_return`` it has no such row but one of its own where a circle leads
    back to it. Circles end the walk since no node is entered twice. Null ends link nothing,
    repeated links and seeds count once. The links are written once, not read at each level.
    """
    once = links.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()
    spread, slots = _spread(cut(once), hub)
    roots = seeds.select("seed").where("seed IS NOT NULL").distinct()
    frontier = cut(roots.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    levels = [] if root_may_return else [frontier]
    for depth in range(1, max_depth + 1):
        here = frontier.select("seed", F.col("node").alias("from_id")).join(slots, "from_id", "left")
        keyed = here.select("seed", "from_id", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
        reached = keyed.join(spread, ["from_id", "slot"]).groupBy("seed", F.col("to_id").alias("node")).agg(F.min("from_id").alias("parent"))
        if levels:
            seen = reduce(DataFrame.unionByName, [x.select("seed", "node") for x in levels])
            reached = reached.join(seen, ["seed", "node"], "left_anti")
        frontier = cut(reached.select("seed", "node", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels) if levels else frontier


def nearest_above(links: DataFrame, marks: DataFrame, origins: DataFrame, max_depth: int) -> DataFrame:
    """(seed, mark, provider, depth): for each (seed, mark) of ``origins`` the nearest node that carries
    the mark, at most ``max_depth`` links above the seed; of equally near ones the least. Null
    provider and depth where there is none. ``marks`` has node and mark."""
    up = links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    reached = walk(up, origins.select("seed"), max_depth, root_may_return=True)
    found = origins.select("seed", "mark").distinct().join(reached, "seed").join(marks.select("node", "mark").distinct(), ["node", "mark"])
    best = found.groupBy("seed", "mark").agg(F.min(F.struct("depth", "node")).alias("best"))
    return origins.select("seed", "mark").distinct().join(best, ["seed", "mark"], "left").select("seed", "mark", F.col("best.node").alias("provider"), F.col("best.depth").alias("depth"))
