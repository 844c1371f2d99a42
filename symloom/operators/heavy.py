"""Results per key where a few keys hold most rows: eager aggregation, also through joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(rows: DataFrame, keys: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """One compact state per key: ``n`` rows and, for each entry of ``sums``, its sum over them.

    Every map task combines its rows first, so a key of any weight reaches the shuffle as one
    state per task.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in (sums or {}).items()])


def joined_states(left: DataFrame, right: DataFrame, on: str, left_sums: list[str], right_sums: list[str], keep_lost: bool = False) -> DataFrame:
    """Counts and sums over the join of two inputs, from their states alone.

    ``left`` may have finer keys than ``on``; ``right`` has one state per ``on``. A left row meets
    every right row of its key, so row counts multiply and a side's sums are multiplied by the
    other side's count. Keys without a partner, null keys included, have no joined row; with
    ``keep_lost`` they stay, with 0 rows and sums, and all keep their own ``n``.
    """
    other = right.select(on, F.col("n").alias("n_right"), *[F.col(c).alias(f"right_{c}") for c in right_sums])
    met = left.join(other, on, "left" if keep_lost else "inner")
    if keep_lost:
        met = met.fillna(0, ["n_right", *[f"right_{c}" for c in right_sums]])
    keep = [c for c in left.columns if c not in ({*left_sums} if keep_lost else {"n", *left_sums})]
    return met.select(
        *keep,
        (F.col("n") * F.col("n_right")).alias("n_joined"),
        *[(F.col(c) * F.col("n_right")).alias(f"joined_{c}") for c in left_sums],
        *[(F.col(f"right_{c}") * F.col("n")).alias(f"joined_{c}") for c in right_sums],
    )


def roll_up(states: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Coarser results from finer states."""
    return states.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def distinct_per_key(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key: repeats go first, under the full (keys, value), so that a hot key's
    values are spread; what is left is counted map-side."""
    return rows.select(*keys, value).where(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))


def heavy_keys(states: DataFrame, one_in: int, keys: list[str], everything: DataFrame | None = None) -> DataFrame:
    """The keys whose states hold at least one in ``one_in`` of all rows (those of ``everything``, if given).

    A key with a null part counts in the total and is never reported; no rows give no keys.
    """
    total = (states if everything is None else everything).agg(F.sum("n").alias("total"))
    return states.dropna(subset=keys).where(F.col("n") * F.lit(one_in) >= total.scalar())
