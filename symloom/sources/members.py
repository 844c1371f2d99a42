"""Tables of what Swift files declare, wrap, inject, compose and import, and the index that these make:
symbols by qualified name and edges between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.sources import reader
from symloom.sources.reader import FACTS

_LISTS = ("attributes", "modifiers", "inherited_types")
_KEY = ["projectId", "filePath"]


def declaration_facts(sources: DataFrame) -> DataFrame:
    """The declarations among the ``facts`` of each file."""
    return reader.facts(sources, "declaration").drop("source")


def facts(sources: DataFrame) -> DataFrame:
    """The facts of each file with content, each file once: declarations, imports, wrappers, environment keys and
    injections, composed views; ``pos`` is their order in the file.

    An injection has the line on which its statement begins.
    """
    return sourced_facts(sources).drop("source")


def sourced_facts(sources: DataFrame) -> DataFrame:
    """``facts``, views with ``source``: the qualified name of the first declaration of their parent's name in the file,
    as ``_views`` would find it by a join."""
    return reader.facts(sources)


def declarations(found: DataFrame) -> DataFrame:
    """(projectId, filePath, kind, name, parent, line, column, end_line, access_level, attributes, modifiers,
    inherited_types, signature, documentation) of types, their members and top-level declarations, a row
    for each name of a ``var`` or ``case``; what stands in bodies is left out."""
    return found.where("fact = 'declaration'").select(*_KEY, "kind", "name", "parent", "line", "column", "end_line", "access_level", *_LISTS, "signature", "documentation")


def _qualified() -> Column:
    file = F.element_at(F.split("filePath", "/"), -1)
    return (
        F.when(F.col("kind") == "extension", F.concat("name", F.lit("+"), file, F.lit(":"), F.col("line").cast("string")))
        .when(F.col("parent").isNotNull(), F.concat("parent", F.lit("."), "name"))
        .when(F.col("kind").isin("function", "variable", "initializer"), F.concat(file, F.lit(":"), "name"))
        .otherwise(F.col("name"))
    )


def _declared(found: DataFrame) -> DataFrame:
    return found.where("fact = 'declaration'").withColumn("qualifiedName", _qualified())


def _first(declared: DataFrame, name: str, to: str, *others: str) -> DataFrame:
    """The first declaration of each name in a file: its qualified name as ``to``, with its place."""
    first = declared.groupBy(*_KEY, F.col("name").alias(name)).agg(F.min(F.struct("pos", "qualifiedName", *others)).alias("first"))
    return first.select(*_KEY, name, F.col("first.pos").alias("first_pos"), F.col("first.qualifiedName").alias(to))


def symbols(found: DataFrame) -> DataFrame:
    """The index's symbols, one per (projectId, qualifiedName): declarations, of which the last by path and
    place counts, files that import, modules, and placeholders of views that no project's file declares.

    Lists are JSON, and null where empty. Facts that have ``source`` are read once: each gives the rows of its symbols,
    and all of these meet in one grouping, what a declaration says in one short text.
    """
    col = F.col
    said = {"kind": "string", "name": "string", "line": "int", "column": "int", "end_line": "int", "access_level": "string", "signature": "string", "documentation": "string"} | dict.fromkeys(_LISTS, "array<string>")
    declares, imports = col("fact") == "declaration", col("fact") == "import"
    shows = (col("fact") == "view") & col("source").isNotNull() & col("projectId").isNotNull()
    text = F.to_json(F.struct(*[(F.when(F.size(c) > 0, col(c)) if c in _LISTS else col(c)).alias(f"c{i}") for i, c in enumerate(said)]))
    none = F.lit(None).cast("struct<path:string,pos:int,text:string>")
    row = lambda sort, key, real=F.lit(None).cast("boolean"), last=none: F.struct(F.lit(sort).cast("byte").alias("sort"), key.alias("key"), real.alias("real"), last.alias("last"))  # noqa: B008, E731
    made = F.array(
        F.when(declares, row(0, _qualified(), last=F.struct(col("filePath").alias("path"), "pos", text.alias("text")))),
        F.when(imports, row(1, col("filePath"))),
        F.when(imports, row(2, col("name"))),
        # A view's name waits for a type as long as none has that name.
        F.when(shows | (declares & col("kind").isin("struct", "class")), row(3, col("name"), declares)),
    )
    rows = _sourced(found).select("projectId", F.explode(F.array_compact(made)).alias("r")).select("projectId", "r.*")
    keys = ["projectId", "sort", "key"]
    # Few rows are alike, so they are sorted only once they have met.
    met = rows.repartition(*keys).groupBy(*keys).agg(F.max("last").alias("last"), F.coalesce(F.max("real"), F.lit(False)).alias("real")).where("NOT real")
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate(said.values()))
    told = met.select(*keys, "last.path", F.from_json("last.text", schema, {"maxStringLen": str((1 << 31) - 1)}).alias("v"))
    of = {c: col(f"v.c{i}") for i, c in enumerate(said)}
    sort, file, empty = col("sort"), col("sort") == 1, F.lit(None).cast("string")
    prefix = F.when(sort == 0, "").when(file, "file:").when(sort == 2, "module:").otherwise("unresolved:")
    return told.select(
        "projectId", F.concat(prefix, "key").alias("qualifiedName"), F.when(sort == 0, of["kind"]).when(file, "file").when(sort == 2, "module").otherwise("struct").alias("kind"),
        F.when(sort == 0, of["name"]).when(file, F.element_at(F.split("key", "/"), -1)).otherwise(col("key")).alias("name"), F.when(file, col("key")).otherwise(col("path")).alias("filePath"),
        F.when(file, 1).otherwise(of["line"]).alias("line"), F.when(file, 1).otherwise(of["column"]).alias("column"), of["end_line"].alias("endLine"), of["access_level"].alias("accessLevel"),
        *[F.coalesce(F.to_json(of[c]), empty).alias(n) for c, n in zip(_LISTS, ("attributes", "modifiers", "inheritedTypes"), strict=True)], of["signature"].alias("signature"), of["documentation"].alias("documentation"),
    )


def _sourced(found: DataFrame) -> DataFrame:
    """Facts with ``source``, if need be by a join."""
    if "source" in found.columns:
        return found
    return found.join(_first(_declared(found), "parent", "source").drop("first_pos"), [*_KEY, "parent"], "left")


def _views(found: DataFrame) -> DataFrame:
    """(projectId, filePath, pos, source, target, is_placeholder, name, argument) of each composed view."""
    real = _declared(found).where("kind IN ('struct', 'class')").groupBy("projectId", "name").agg(F.min("qualifiedName").alias("real"))
    views = _sourced(found).where("fact = 'view' AND source IS NOT NULL AND projectId IS NOT NULL").select(*_KEY, "pos", "name", "argument", "source")
    met = views.join(real, ["projectId", "name"], "left")
    return met.select(*_KEY, "pos", "source", F.coalesce("real", F.concat(F.lit("unresolved:"), "name")).alias("target"), F.col("real").isNull().alias("is_placeholder"), "name", "argument")


def edges(found: DataFrame) -> DataFrame:
    """(projectId, source, target, kind, metadata) between qualified names: ``contains`` from the first type
    of the parent's name in the file, ``imports`` from files to modules, ``composesView``. Of equal links
    the first by path and place counts."""
    declared = _declared(found)
    place = F.struct("filePath", "pos").alias("place")
    parents = _first(declared.where("kind NOT IN ('function', 'variable')"), "parent", "source")
    contains = declared.join(parents, [*_KEY, "parent"]).where("first_pos < pos").select("projectId", "source", F.col("qualifiedName").alias("target"), F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("metadata"), place)
    imports = found.where("fact = 'import'").select(
        "projectId", F.concat(F.lit("file:"), "filePath").alias("source"), F.concat(F.lit("module:"), "name").alias("target"), F.lit("imports").alias("kind"), F.when(F.col("testable"), '{"testable":true}').alias("metadata"), place
    )
    composes = _views(found).select("projectId", "source", "target", F.lit("composesView").alias("kind"), F.col("argument").alias("metadata"), place)
    rows = contains.unionByName(imports).unionByName(composes)
    return rows.groupBy("projectId", "source", "target", "kind").agg(F.min(F.struct("place", "metadata")).alias("first")).select("projectId", "source", "target", "kind", F.col("first.metadata").alias("metadata"))


def wrappers(found: DataFrame) -> DataFrame:
    """(projectId, filePath, symbol, wrapperName, argument, view, line) of property wrappers; the symbol is the
    first variable of that name in the file, and uses on names that have none are left out."""
    used = found.where("fact = 'wrapper'").select(*_KEY, "name", F.col("kind").alias("wrapperName"), "argument", F.col("parent").alias("view"), "line")
    return used.join(_first(_declared(found).where("kind = 'variable'"), "name", "symbol"), [*_KEY, "name"]).select(*_KEY, "symbol", "wrapperName", "argument", "view", "line")


def environment_keys(found: DataFrame) -> DataFrame:
    """(projectId, keyName, valueType, declaring, filePath, line), one per key: its last declaration by path
    and place; ``declaring`` is the first declaration of the type in that file."""
    keys = found.where("fact = 'key'").select(*_KEY, "pos", F.col("name").alias("keyName"), F.col("signature").alias("valueType"), "parent", "line")
    last = keys.groupBy("projectId", "keyName").agg(F.max(F.struct("filePath", "pos", "valueType", "parent", "line")).alias("last")).select("projectId", "keyName", "last.*")
    return last.join(_first(_declared(found), "parent", "declaring"), [*_KEY, "parent"], "left").select("projectId", "keyName", "valueType", "declaring", "filePath", "line")


def environment_injections(found: DataFrame) -> DataFrame:
    """(projectId, filePath, view, keyPath, line) of each ``environment`` modifier in a type that has a symbol."""
    given = found.where("fact = 'injection'").select(*_KEY, "parent", F.col("argument").alias("keyPath"), "line")
    return given.join(_first(_declared(found), "parent", "view"), [*_KEY, "parent"]).select(*_KEY, "view", "keyPath", "line")
