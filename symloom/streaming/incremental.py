"""Upkeep of an index from a stream of file versions.

The stream has projectId, filePath and content and, if it can, version (a number that grows with
each version of a file) and deleted. State is kept per file: its last version, and the hash of its
content. Of the versions of a file that come together the newest counts; it passes when its hash
differs, so repeats, late versions and restarts cost a comparison, and extraction runs on what
changed only. A deleted file passes once, and leaves no facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symloom.session import cut
from symloom.sources.members import declarations, facts

VERSIONS = "projectId long, filePath string, content string"


def _pass_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """At most one row per file and trigger: the newest version, if it changes what is known."""
    tops = [b.sort_values(["version", "deleted", "content"], na_position="first").tail(1) for b in batches]
    newest = pd.concat(tops).sort_values(["version", "deleted", "content"], na_position="first").tail(1)
    version, digest = state.get if state.exists else (None, None)
    top = int(newest["version"].iloc[0])
    if version is not None and top < version:
        return
    state.update((top, newest["digest"].iloc[0]))
    if newest["digest"].iloc[0] != digest:
        yield newest[["projectId", "filePath", "content", "version", "deleted"]]


def changed_versions(stream: DataFrame) -> DataFrame:
    """(projectId, filePath, content, version, deleted): the versions of a stream that differ from what the file
    was before.

    Without a version column what comes later is newer, and of several contents of a file in one
    trigger the greatest counts. Versions older than one seen before are left out. Rows without a
    project or a path name no version, nor do rows without content that delete nothing. The
    content of a deletion is null.
    """
    version = F.coalesce(F.col("version").cast("long"), F.lit(0)) if "version" in stream.columns else F.lit(0).cast("long")
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in stream.columns else F.lit(False)
    known = stream.where("projectId IS NOT NULL AND filePath IS NOT NULL").select("projectId", "filePath", "content", version.alias("version"), deleted.alias("deleted")).where("deleted OR content IS NOT NULL")
    known = known.withColumns({"content": F.when(~F.col("deleted"), F.col("content")), "digest": F.when(F.col("deleted"), "deleted").otherwise(F.sha2(F.col("content").cast("binary"), 256))})
    return known.groupBy("projectId", "filePath").applyInPandasWithState(_pass_changes, f"{VERSIONS}, version long, deleted boolean", "version long, digest string", "append", GroupStateTimeout.NoTimeout)


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the facts of changed files (``members.facts``) below ``table``, a folder per batch, until the source is drained.

    A batch that is run again overwrites its own folder; a file without facts, emptied or deleted, has
    one row without a fact in it. ``current_facts`` reads the newest state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        found = batch.select("projectId", "filePath").join(facts(batch.where("NOT deleted")), ["projectId", "filePath"], "left")
        found.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changed_versions(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, table: str) -> DataFrame:
    """The facts of each file by its newest batch, from which ``members`` makes symbols, edges and the tables
    of wrappers, keys and injections; a file emptied of facts has none."""
    rows = spark.read.option("basePath", table).parquet(table)
    newest = rows.groupBy("projectId", "filePath").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["projectId", "filePath", "batch"]).where("fact IS NOT NULL").drop("batch")


def current(spark: SparkSession, table: str) -> DataFrame:
    """The declarations of each file by its newest batch; a file emptied of declarations has none."""
    return declarations(current_facts(spark, table))
