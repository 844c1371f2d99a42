"""The tables of the index as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "projects", "modules", "symbols", "shared_symbols", "edges", "file_hashes", "source_files",
    "symbol_snapshots", "eval_items", "documents",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder that holds ``<name>.parquet`` files or directories."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
