"""Parent-child links to full hierarchies.

Links are contracted where they lie: every partition follows its own parent chains up to the
first node whose link it doesn't hold (the fragment's exit). The exits that have a parent
themselves form a much smaller quotient forest, which the same steps solve again; when the
quotient stops shrinking, its chains are halved by joins until they end. Fragment results are
then expanded by what was found for their exits. A chain that never ends is a circle, whether
inside one partition or across many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import cut

CIRCLE = -1


def parent_links(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """One link (child, parent) per child.

    Rows with a null end link nothing. Repeated links count once. A child with several parents
    keeps the smallest parent id.
    """
    return (
        edges.select(F.col(child).cast("long").alias("child"), F.col(parent).cast("long").alias("parent"))
        .where("child IS NOT NULL AND parent IS NOT NULL")
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )


def _climb(child: np.ndarray, parent: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exit, hops to it and whether the chain is a circle, for links sorted by child."""
    n = len(child)
    at = np.searchsorted(child, parent)
    at[at == n] = 0
    inside = child[at] == parent
    jump = np.where(inside, at, np.arange(n))
    ends = ~inside
    exits, dist = parent.copy(), np.where(ends, 0, hops)  # dist: hops up to the link jumped to
    for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
        dist = dist + dist[jump]
        jump = jump[jump]
    circle = ~ends[jump]
    return np.where(circle, CIRCLE, exits[jump]), np.where(circle, CIRCLE, dist + hops[jump]), circle


def _fragments(with_path: bool):
    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        links = pd.concat(parts, ignore_index=True).sort_values("child", ignore_index=True)
        child, parent = links["child"].to_numpy(), links["parent"].to_numpy()
        exits, hops, circle = _climb(child, parent, links["hops"].to_numpy())
        out = pd.DataFrame({"part": int(child[0]), "child": child, "exit": exits, "hops": hops})
        if not with_path:
            yield out
            return
        segment = dict(zip(child.tolist(), links["segment"], strict=True))
        up = dict(zip(child.tolist(), parent.tolist(), strict=True))
        for start in range(0, len(out), 10_000):  # paths are built and handed over piece by piece
            piece = out.iloc[start : start + 10_000].copy()
            paths = []
            for node, bad in zip(piece["child"].tolist(), circle[start : start + 10_000], strict=True):
                chain, x = [], node
                while not bad and x in up:
                    chain.append(segment[x])
                    x = up[x]
                paths.append(np.concatenate(chain[::-1]) if chain else np.array([], dtype=np.int64))
            piece["segment"] = paths
            yield piece

    return contract


def _halve(links: DataFrame, rounds: int) -> DataFrame:
    """Chains by doubling: each round replaces a link's parent by the parent's own link."""
    for _ in range(rounds):
        up = links.select(F.col("child").alias("parent"), F.col("parent").alias("above"), F.col("hops").alias("more"), *([F.col("segment").alias("head")] if "segment" in links.columns else []))
        grown = links.join(up, "parent", "left")
        links = cut(
            grown.select(
                "child",
                F.coalesce("above", "parent").alias("parent"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                *([F.when(F.col("head").isNotNull(), F.concat("head", "segment")).otherwise(F.col("segment")).alias("segment")] if "segment" in links.columns else []),
            )
        )
        if links.join(links.select(F.col("child").alias("parent")), "parent", "left_semi").isEmpty():
            break
    open_ = links.join(links.select(F.col("child").alias("parent"), F.lit(True).alias("open")).distinct(), "parent", "left")
    return open_.select(
        "child",
        F.when(F.col("open"), F.lit(CIRCLE)).otherwise(F.col("parent")).alias("root"),
        F.when(F.col("open"), F.lit(CIRCLE)).otherwise(F.col("hops")).alias("depth"),
        *(["segment"] if "segment" in links.columns else []),
    )


def _solve(links: DataFrame, fragment_rows: int, before: int | None) -> DataFrame:
    """(child, root, depth[, segment]) of weighted links (child, parent, hops[, segment])."""
    with_path = "segment" in links.columns
    links = cut(links)
    n = links.count()
    if before is not None and n > fragment_rows and 2 * n > before:
        return _halve(links, math.ceil(math.log2(n + 1)) + 1)
    parts = max(1, math.ceil(n / fragment_rows))
    placed = links.repartition(1) if parts == 1 else links.repartitionByRange(parts, "child")
    schema = "part long, child long, exit long, hops long" + (", segment array<long>" if with_path else "")
    pieces = placed.mapInPandas(_fragments(with_path), schema)
    if parts == 1:
        return pieces.select("child", F.col("exit").alias("root"), F.col("hops").alias("depth"), *(["segment"] if with_path else []))
    pieces = cut(pieces)
    # One row per fragment and exit, so that an exit with very many nodes below it isn't a hot join key.
    doors = pieces.where(F.col("hops") != CIRCLE).groupBy("part", "exit").agg(F.lit(1).alias("one")).drop("one")
    quotient = pieces.join(doors.select(F.col("exit").alias("child")).distinct(), "child", "left_semi").select(
        "child", F.col("exit").alias("parent"), "hops", *(["segment"] if with_path else [])
    )
    stuck = quotient.where(F.col("hops") == CIRCLE).select("child", F.lit(CIRCLE).cast("long").alias("root"), F.lit(CIRCLE).cast("long").alias("depth"), *([F.col("segment")] if with_path else []))
    solved = _solve(quotient.where(F.col("hops") != CIRCLE), fragment_rows, n)
    # A chain may end at an exit that its own fragment already found to be on or below a circle.
    known = solved.unionByName(stuck).alias("k")
    top = known.join(stuck.select(F.col("child").alias("root"), F.lit(True).alias("dead")), "root", "left").select(
        F.col("child").alias("exit"),
        F.when(F.col("dead"), F.lit(CIRCLE)).otherwise(F.col("root")).alias("top"),
        F.when(F.col("dead"), F.lit(CIRCLE)).otherwise(F.col("depth")).alias("above"),
        *([F.col("segment").alias("head")] if with_path else []),
    )
    by_door = doors.join(top, "exit", "left")
    full = pieces.join(by_door, ["part", "exit"], "left")
    bad = (F.col("hops") == CIRCLE) | (F.coalesce("above", F.lit(0)) == CIRCLE)
    return full.select(
        "child",
        F.when(bad, F.lit(CIRCLE)).otherwise(F.coalesce("top", "exit")).alias("root"),
        F.when(bad, F.lit(CIRCLE)).otherwise(F.col("hops") + F.coalesce("above", F.lit(0))).alias("depth"),
        *([F.when(F.col("head").isNotNull(), F.concat("head", "segment")).otherwise(F.col("segment")).alias("segment")] if with_path else []),
    )


def hierarchy(edges: DataFrame, child: str, parent: str, with_path: bool = False, fragment_rows: int = 50_000) -> DataFrame:
    """(node_id, root_id, depth[, path]) of every id that occurs at either end of a link.

    A root has itself and depth 0. Nodes on or below a circle, a link to oneself included, have
    root_id and depth -1 and a null path. ``path`` holds the ids from the root to the node.
    An id that only occurs in rows whose other end is null is a root. An empty table gives an
    empty result; further columns of ``edges`` are ignored. ``fragment_rows`` bounds what one
    task holds.
    """
    ends = edges.select(F.col(child).cast("long").alias("c"), F.col(parent).cast("long").alias("p"))
    links = parent_links(edges, child, parent).withColumn("hops", F.lit(1).cast("long"))
    if with_path:
        links = links.withColumn("segment", F.array("child"))
    found = _solve(links, fragment_rows, None)
    below = found.select(F.col("child").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), *(["segment"] if with_path else []))
    every = ends.select(F.explode(F.array("c", "p")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    out = every.join(below, "node_id", "left")
    columns = ["node_id", F.coalesce("root_id", "node_id").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("depth")]
    if with_path:
        path = F.when(F.col("depth").isNull(), F.array("node_id")).when(F.col("depth") != CIRCLE, F.concat(F.array("root_id"), F.col("segment")))
        columns.append(path.alias("path"))
    return out.select(*columns)


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every node and each node above it, from paths of ``hierarchy``."""
    return paths.where("depth > 0").select(
        F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor_id"), "node_id", "depth"
    ).select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))


def circles(edges: DataFrame, child: str, parent: str, fragment_rows: int = 50_000) -> DataFrame:
    """(node_id, place) of the nodes without a root: ``on`` a circle or ``below`` one.

    Following parents once more than there are such nodes leads from any of them onto its
    circle, and reaches every node of the circle; the steps are doubled.
    """
    links = parent_links(edges, child, parent)
    lost = hierarchy(edges, child, parent, fragment_rows=fragment_rows).where(F.col("depth") == CIRCLE).select(F.col("node_id").alias("child"))
    jump = cut(links.join(lost, "child", "left_semi"))
    base = jump
    for _ in range(math.ceil(math.log2(jump.count() + 1)) + 1):
        jump = cut(jump.join(jump.select(F.col("child").alias("parent"), F.col("parent").alias("next")), "parent").select("child", F.col("next").alias("parent")))
    on = jump.select(F.col("parent").alias("child")).distinct().withColumn("on", F.lit(True))
    return base.join(on, "child", "left").select(F.col("child").alias("node_id"), F.when(F.col("on"), "on").otherwise("below").alias("place"))
