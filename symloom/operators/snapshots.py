"""What changed between full snapshots: gaps and islands over key and row state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}\x{85}\x{FEFF}\x{200B}]"


def trimmed(column: Column | str) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(column, f"\\A{BLANK}++|(?<!{BLANK}){BLANK}++\\z", "")


def without_space(column: Column | str) -> Column:
    """Without white space anywhere; null where nothing is left."""
    return F.nullif(F.regexp_replace(column, f"{BLANK}+", ""), F.lit(""))


def validity_intervals(rows: DataFrame, group: str, number: str, key: Column, state: list[Column], newest: list[Column], salts: int = 16) -> DataFrame:
    """Islands (group, key, state, first, last) of unbroken presence of one state of a key.

    ``first`` and ``last`` count the snapshots that were delivered for the group, from 1;
    ``first_no``, ``next_no`` are the numbers of the island's first snapshot and of the one
    after its last (null at the end). Within a snapshot the row with the greatest ``newest``
    counts; of equal ones the greatest state, so repeated rows and ties have one result.
    Rows without a group, a number or a key belong to no record, yet a snapshot that holds only
    such rows was delivered.
    """
    named = rows.select(F.col(group).alias("grp"), F.col(number).alias("no"), key.alias("key"), F.struct(*state).alias("state"), F.struct(*newest).alias("newest")).where("grp IS NOT NULL AND no IS NOT NULL")
    # One short row per delivery of a group; its copies spread the records of a hot group.
    deliveries = Window.partitionBy("grp").orderBy("no")
    calendar = (
        named.select("grp", "no").distinct()
        .select("grp", "no", F.row_number().over(deliveries).cast("long").alias("at"), F.lead("no").over(deliveries).alias("next_no"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    # Full rows meet in a map-side combined maximum, never in a sorted group.
    records = (
        named.where("key IS NOT NULL AND key <> ''")
        .groupBy("grp", "key", "no")
        .agg(F.max(F.struct("newest", "state")).alias("kept"))
        .select("grp", "key", "no", "kept.state", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"))
        .join(calendar, ["grp", "no", "salt"])
    )
    by_key = Window.partitionBy("grp", "key").orderBy("at")
    starts = (F.lag("at").over(by_key).eqNullSafe(F.col("at") - 1) & F.lag("state").over(by_key).eqNullSafe(F.col("state"))) == F.lit(False)
    islands = records.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(by_key))
    return (
        islands.groupBy("grp", "key", "island")
        .agg(F.min("at").alias("first"), F.max(F.struct("at", "next_no")).alias("end"), F.first("state").alias("state"), F.min("no").alias("first_no"))
        .select("grp", "key", "state", "first", F.col("end.at").alias("last"), "first_no", "end.next_no")
    )


def change_events(intervals: DataFrame) -> DataFrame:
    """(grp, no, key, change): each island's start is an addition, or a change where it adjoins the
    island before; each end that nothing adjoins and a later snapshot follows is a removal."""
    by_key = Window.partitionBy("grp", "key").orderBy("first")
    seen = intervals.withColumn("joins_last", F.lag("last").over(by_key) == F.col("first") - 1).withColumn("joins_next", F.lead("first").over(by_key) == F.col("last") + 1)
    start = F.when(F.col("first") > 1, F.struct(F.col("first_no").alias("no"), F.when(F.col("joins_last"), "changed").otherwise("added").alias("change")))
    end = F.when(F.col("next_no").isNotNull() & ~F.coalesce("joins_next", F.lit(False)), F.struct(F.col("next_no").alias("no"), F.lit("removed").alias("change")))
    return seen.select("grp", "key", F.explode(F.array(start, end)).alias("event")).where("event IS NOT NULL").select("grp", F.col("event.no").alias("no"), "key", F.col("event.change").alias("change"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(project_id, snapshot_no, qualified_name, change) between consecutive snapshots of a project.

    White space around a name and anywhere in a signature doesn't count, a blank signature is
    null, and every other difference in signature or kind is a change. Rows with a null or blank
    name are no record. Columns other than those named are ignored.
    """
    intervals = validity_intervals(
        snapshots, "projectId", "snapshotNo", trimmed("qualifiedName"),
        [without_space("signature").alias("signature"), F.col("kind").alias("kind")],
        [F.col("deliveredAt"), F.col("id")],
    )
    return change_events(intervals).select(F.col("grp").alias("project_id"), F.col("no").alias("snapshot_no"), F.col("key").alias("qualified_name"), "change")
