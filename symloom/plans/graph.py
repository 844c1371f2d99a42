"""The code graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.paths import inner_path
from symloom.operators.records import cascade, unique_by
from symloom.operators.snapshots import trimmed
from symloom.sources.tables import table


@dataclass(frozen=True)
class Graph:
    """Raw tables of an index: repeats, blanks around kinds and ends that are gone included.

    ``nodes`` and ``links`` give the graph itself. ``symbols`` already holds shared ones.
    """

    symbols: DataFrame
    edges: DataFrame
    modules: DataFrame
    projects: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Graph:
        symbols = table(spark, folder, "symbols").unionByName(table(spark, folder, "shared_symbols"))
        return cls(symbols, *(table(spark, folder, t) for t in ("edges", "modules", "projects")))

    def nodes(self, *columns: str) -> DataFrame:
        """Each symbol once, with id and the given columns; rows without an id are none."""
        return unique_by(self.symbols.where("id IS NOT NULL"), ["id"], *columns)

    def links(self, *kinds: str) -> DataFrame:
        """(sourceId, targetId, kind, id) of each edge between existing symbols once, with its lowest id (all
        kinds, or those given). No question asks for metadata, so this stays a hash aggregate."""
        kind = trimmed("kind")
        edges = self.edges.where(kind.isin(*kinds)) if kinds else self.edges
        return cascade(edges.groupBy("sourceId", "targetId", kind.alias("kind")).agg(F.min("id").alias("id")), self.symbols)

    def module_of(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (with projectId, moduleId and filePath) and module_id, module, module_kind.

        A symbol without a module takes each module whose path lies in its file's path, so it may
        get several rows; without any it keeps one with nulls.
        """
        named = unique_by(self.modules, ["id"], "name", "kind").select(F.col("id").alias("module_id"), F.col("name").alias("module"), F.col("kind").alias("module_kind"))
        homeless = nodes.where("moduleId IS NULL").select("projectId", "filePath")
        by_path = inner_path(homeless, self.modules).withColumnRenamed("moduleId", "path_module")
        placed = nodes.where("moduleId IS NULL").join(by_path, ["projectId", "filePath"], "left").unionByName(nodes.where("moduleId IS NOT NULL").withColumn("path_module", F.lit(None).cast("long")))
        return placed.withColumn("module_id", F.coalesce("moduleId", "path_module")).drop("path_module").join(named, "module_id", "left")
