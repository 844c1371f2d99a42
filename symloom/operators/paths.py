"""Files to modules by path, as equality joins on path prefixes and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(projectId, filePath, moduleId) by the longest module folder that a file lies in.

    ``files`` has projectId and filePath; ``folders`` projectId, moduleId and folder, without a
    slash at its end. A path has few folders above it, so each is a join key: no comparison of all
    files with all folders. Of equal folders the lowest moduleId is taken; files in none have null.
    """
    parts = F.split("filePath", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keys = files.select("projectId", "filePath").distinct().where("filePath IS NOT NULL")
    named = folders.where("folder IS NOT NULL AND folder <> ''").groupBy("projectId", "folder").agg(F.min("moduleId").alias("moduleId"))
    hits = keys.select("projectId", "filePath", F.explode(above).alias("folder")).join(named, ["projectId", "folder"])
    best = hits.groupBy("projectId", "filePath").agg(F.max(F.struct(F.length("folder"), "moduleId")).alias("best"))
    return keys.join(best, ["projectId", "filePath"], "left").select("projectId", "filePath", F.col("best.moduleId").alias("moduleId"))


def inner_path(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(projectId, filePath, moduleId) for each module whose path stands anywhere between slashes in the
    file's path, letter case aside; a file may match several modules or none (then it has no row)."""
    parts = F.split(F.lower("filePath"), "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("inner"), F.lit(1))), lambda i: i <= F.size("inner"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.size("inner")), lambda j: F.array_join(F.slice("inner", i, j - i + 1), "/"))))
    keys = files.select("projectId", "filePath").distinct().where("filePath IS NOT NULL").withColumn("inner", inner)
    named = modules.where("path IS NOT NULL").select("projectId", F.lower("path").alias("run"), F.col("id").alias("moduleId")).distinct()
    return keys.select("projectId", "filePath", F.explode(F.array_distinct(runs)).alias("run")).join(named, ["projectId", "run"]).select("projectId", "filePath", "moduleId").distinct()
