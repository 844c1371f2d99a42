"""Source files: discovery, hashes, what changed, and slices of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that discovery leaves out.
EXCLUDED = (".build", ".git", ".index-build", ".swiftpm", "Build", "Carthage", "DerivedData", "Pods")


def discover(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(filePath, content, sha256) of the Swift files below ``root``.

    Hidden files and folders and those named in ``EXCLUDED`` or ``exclude`` are left out, as are
    files that aren't UTF-8.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.swift").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", "^file:(//)?", "")
    parts = F.split(F.substr(path, F.length(base) + 1), "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*EXCLUDED, *exclude))
    return files.select(path.alias("filePath"), F.col("content").alias("bytes")).where(~hidden).select(
        "filePath", F.try_validate_utf8(F.col("bytes").cast("string")).alias("content"), F.sha2("bytes", 256).alias("sha256")
    ).where("content IS NOT NULL")


def latest_hashes(hashes: DataFrame) -> DataFrame:
    """(projectId, filePath, sha256) of each file's newest state, however late older ones arrive."""
    return hashes.groupBy("projectId", "filePath").agg(F.max(F.struct("lastIndexed", "id", "sha256")).alias("newest")).select("projectId", "filePath", "newest.sha256")


def file_states(sources: DataFrame, hashes: DataFrame, force: bool = False) -> DataFrame:
    """(projectId, filePath, state): ``new``, ``changed``, ``same``, ``deleted`` or ``unreadable``.

    A file is compared by the SHA-256 of its content; one without content can't be. With ``force``
    every readable file is ``changed`` and none is looked for among the deleted.
    """
    now = sources.groupBy("projectId", "filePath").agg(F.max("content").alias("content")).select("projectId", "filePath", F.lit(True).alias("here"), F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    if force:
        return now.select("projectId", "filePath", F.when(F.col("now").isNull(), "unreadable").otherwise("changed").alias("state"))
    stored = latest_hashes(hashes).withColumnRenamed("sha256", "stored")
    state = (
        F.when(F.col("here").isNull(), "deleted").when(F.col("now").isNull(), "unreadable").when(F.col("stored").isNull(), "new")
        .when(F.col("now") == F.col("stored"), "same").otherwise("changed")
    )
    return now.join(stored, ["projectId", "filePath"], "full_outer").select("projectId", "filePath", state.alias("state"))


BLOCK = 1000  # lines of a file whose slices are made together


def split_lines(content: Column | str) -> Column:
    return F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")


def numbered_lines(content: Column | str, first: Column, last: Column, mark: Column | None = None) -> Column:
    """Lines ``first`` to ``last`` (from 1) as ``   7 | text``; the line ``mark`` begins with ``>``.

    Bounds beyond the text are moved to its ends; null where a bound or the text is null.
    """
    return numbered(split_lines(content), first, last, mark)


def numbered(lines: Column, first: Column, last: Column, mark: Column | None = None) -> Column:
    """``numbered_lines`` of a text that is split already."""
    start, end = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    sign = (lambda i: F.lit("")) if mark is None else (lambda i: F.when(i == mark, ">").otherwise(" "))
    kept = F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))
    return F.array_join(F.transform(kept, lambda x, i: F.concat(sign(i + start), F.format_string("%4d | %s", i + start, x))), "\n")


def slices(ranges: DataFrame, sources: DataFrame, keys: list[str], marked: bool = False) -> DataFrame:
    """(*keys, first, last[, mark], source) of each distinct range of lines of files that ``sources`` has.

    The ranges that begin in one block of a file's lines are gathered, which the block bounds, and
    cut out together: a file is joined once per block, not once per range. The source is null where
    the file's content is; of several contents of a file the greatest counts.
    """
    bounds = ["first", "last", *(["mark"] if marked else [])]
    blocks = ranges.groupBy(*keys, F.floor(F.col("first") / BLOCK).alias("_block")).agg(F.collect_set(F.struct(*bounds)).alias("_ranges"))
    files = sources.groupBy(*keys).agg(F.max("content").alias("content")).select(*keys, split_lines("content").alias("_lines"))
    made = lambda r: F.struct(*[r[b].alias(b) for b in bounds], numbered(F.col("_lines"), r["first"], r["last"], r["mark"] if marked else None).alias("source"))
    return blocks.join(files, keys).select(*keys, F.explode(F.transform("_ranges", made)).alias("_s")).select(*keys, "_s.*")
