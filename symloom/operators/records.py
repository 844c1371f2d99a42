"""Write semantics as DataFrame operators: first writer wins, last writer wins, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_by(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """One row per key with the given columns (default: all); of several the greatest row is kept.

    Rows whose key is null in part form keys like others. Only the needed columns are combined, so
    pruning reaches the scan.
    """
    rest = [c for c in (columns or rows.columns) if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("kept")).select(*keys, "kept.*")


def first_writer_wins(edges: DataFrame, kind: Column) -> DataFrame:
    """One edge per (sourceId, targetId, kind): that of the lowest id, its metadata included.

    Of rows with the same id the one with the least metadata, null first, counts.
    """
    return (
        edges.groupBy("sourceId", "targetId", kind.alias("kind"))
        .agg(F.min(F.struct("id", "metadata", "projectId")).alias("kept"))
        .select("kept.id", "kept.projectId", "sourceId", "targetId", "kind", "kept.metadata")
    )


def last_writer_wins(rows: DataFrame, keys: list[str], order: list[str], keep_first: list[str], take_last: list[str]) -> DataFrame:
    """Upsert of a whole history: per key the columns ``keep_first`` of its first row and ``take_last``
    of its last, in ``order``; ties are broken by the columns' own values."""
    return (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in keep_first])).alias("first"), F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in take_last])).alias("last"), F.count(F.lit(1)).alias("n_writes"))
        .select(*keys, *[F.col(f"first._{c}").alias(c) for c in keep_first], *[F.col(f"last._{c}").alias(c) for c in take_last], "n_writes")
    )


def cascade(edges: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("sourceId", "targetId")) -> DataFrame:
    """The edges all of whose ends exist in ``ids`` (column id): deleting a node deletes its edges."""
    known = ids.select("id").distinct()
    for end in ends:
        edges = edges.join(known.withColumnRenamed("id", end), end, "left_semi")
    return edges


def set_null(rows: DataFrame, reference: str, ids: DataFrame) -> DataFrame:
    """``reference`` is null where it names no row of ``ids``; the other columns stay."""
    known = ids.select(F.col("id").alias(reference)).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, reference, "left").withColumn(reference, F.when(F.col("_known"), F.col(reference))).select(*rows.columns)
