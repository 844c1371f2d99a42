"""Registered queries that read source text, and those that resolve what it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import resolve
from symloom.plans import questions as ask
from symloom.plans.graph import Graph
from symloom.session import cut
from symloom.sources import declarations as read
from symloom.sources import members, reader
from symloom.sources.tables import table


TOOLKIT = 1  # the project that owns the symbols all others see


def _scoped(spark: SparkSession, folder: str) -> DataFrame:
    return read.scoped_tokens(table(spark, folder, "source_files"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return members.facts(table(spark, folder, "source_files"))


def extract_declarations(spark: SparkSession, folder: str) -> DataFrame:
    return members.declarations(members.declaration_facts(table(spark, folder, "source_files")))


def extract_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The extracted declarations that the index has too, at the same place, each once."""
    found = extract_declarations(spark, folder).select("filePath", "kind", "name", "line").distinct()
    return found.join(table(spark, folder, "symbols").select("filePath", "kind", "name", "line"), ["filePath", "kind", "name", "line"], "left_semi")


def extract_imports(spark: SparkSession, folder: str) -> DataFrame:
    return read.imports(_scoped(spark, folder)).select("filePath", "module", "testable", "line")


def extract_calls(spark: SparkSession, folder: str) -> DataFrame:
    return reader.calls(table(spark, folder, "source_files"))


def extract_type_references(spark: SparkSession, folder: str) -> DataFrame:
    return read.type_references(_scoped(spark, folder))


def _nodes(graph: Graph) -> DataFrame:
    return graph.nodes("projectId", "filePath", "line", "name", "qualifiedName", "kind", "inheritedTypes")


def resolve_extensions(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.extension_edges(_nodes(Graph.read(spark, folder)), TOOLKIT)


def resolve_conformances(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.inheritance_edges(_nodes(Graph.read(spark, folder)), TOOLKIT)


def resolve_references(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.reference_edges(_nodes(Graph.read(spark, folder)), extract_type_references(spark, folder), TOOLKIT)


def resolve_calls(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    # Calls are few beside the texts they come from; written once, no text is read again for another way to resolve them.
    calls = cut(extract_calls(spark, folder))
    return resolve.call_edges(graph.nodes("projectId", "filePath", "line", "name", "qualifiedName", "kind"), graph.links("contains"), calls, TOOLKIT)


def find_usages(spark: SparkSession, folder: str) -> DataFrame:
    """Places that use each symbol, type references by the lines on which they stand in the source."""
    graph = Graph.read(spark, folder)
    return ask.find_usages(graph, resolve.reference_sites(_nodes(graph), extract_type_references(spark, folder), TOOLKIT))


def rename_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that a rename of each symbol touches, references and calls by where they stand in the source."""
    graph = Graph.read(spark, folder)
    scoped, nodes = cut(_scoped(spark, folder)), _nodes(graph)
    return ask.rename_sites(graph, resolve.reference_sites(nodes, read.type_references(scoped), TOOLKIT), resolve.call_sites(nodes, graph.links("contains"), read.calls(scoped), TOOLKIT), siblings=False)


def index_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols that the source files make, by qualified name: declarations, files, modules, placeholders."""
    return members.symbols(members.sourced_facts(table(spark, folder, "source_files")))


def index_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that the source files make between qualified names: contains, imports, composed views."""
    return members.edges(cut(_facts(spark, folder)))


def index_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """What the source declares and the index lacks at that place: ``extract_indexed`` is the rest."""
    found = extract_declarations(spark, folder).select("filePath", "kind", "name", "line").distinct()
    return found.join(table(spark, folder, "symbols").select("filePath", "kind", "name", "line"), ["filePath", "kind", "name", "line"], "left_anti")


def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What a full run of extraction gives per project: declarations, and the symbols and edges made of them."""
    found = cut(_facts(spark, folder))
    counts = members.declarations(found).groupBy("projectId").agg(F.count_distinct("filePath").alias("n_files"), F.count(F.lit(1)).alias("n_declarations"), F.count(F.when(F.col("kind") == "function", 1)).alias("n_functions"))
    symbols = members.symbols(found).groupBy("projectId").agg(F.count(F.lit(1)).alias("n_symbols"))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    edges = members.edges(found).groupBy("projectId").agg(of("contains").alias("n_contains"), of("imports").alias("n_imports"), of("composesView").alias("n_compositions"))
    # A project whose files only import has symbols and edges without declarations.
    numbers = ["n_files", "n_declarations", "n_functions", "n_symbols", "n_contains", "n_imports", "n_compositions"]
    return symbols.join(counts, "projectId", "left").join(edges, "projectId", "left").fillna(0, numbers).select(F.col("projectId").alias("project_id"), *numbers)


QUERIES = {
    "extract_declarations": extract_declarations, "extract_indexed": extract_indexed, "extract_imports": extract_imports, "extract_calls": extract_calls, "extract_type_references": extract_type_references,
    "resolve_extensions": resolve_extensions, "resolve_conformances": resolve_conformances, "resolve_references": resolve_references, "resolve_calls": resolve_calls, "find_usages": find_usages, "rename_lines": rename_lines, "index_symbols": index_symbols, "index_edges": index_edges, "index_unknown": index_unknown, "index_summary": index_summary,
}

_S = """WITH s AS (SELECT DISTINCT * FROM symbols UNION SELECT * FROM shared_symbols), real AS (SELECT * FROM s WHERE NOT starts_with(lower(qualifiedName), 'unresolved:')),
clauses AS (SELECT projectId, id, name AS own, kind, unnest(list_distinct(from_json(inheritedTypes, '["VARCHAR"]'))) AS name FROM s)"""

ORACLES = {
    "extract_indexed": "SELECT DISTINCT s.filePath, s.kind, s.name, s.line FROM symbols s JOIN (SELECT DISTINCT filePath FROM source_files WHERE content IS NOT NULL) f ON f.filePath = s.filePath WHERE s.kind <> 'file'",
    "extract_imports": """WITH lines AS (SELECT filePath, string_split(regexp_replace(content, '\r\n?', '\n', 'g'), '\n') AS l FROM (SELECT DISTINCT filePath, content FROM source_files WHERE content IS NOT NULL) f),
numbered AS (SELECT filePath, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM lines),
parts AS (SELECT filePath, line, unnest(string_split(text, ';')) AS text FROM numbered)
SELECT filePath, regexp_extract(text, 'import\\s+(\\w+)', 1) AS module, contains(text, '@testable') AS testable, CAST(line AS INT) AS line FROM parts WHERE regexp_matches(text, '^﻿?\\s*(@testable\\s+)?import\\s+\\w+')""",
    "resolve_extensions": _S
    + """, pairs AS (SELECT x.projectId, x.id AS ext, b.id AS base FROM s x JOIN real b ON b.projectId = x.projectId AND b.name = x.name AND b.kind NOT IN ('extension', 'file', 'module', 'function', 'variable') WHERE x.kind = 'extension'),
protocols AS (SELECT projectId, name, id FROM real WHERE kind = 'protocol' QUALIFY row_number() OVER (PARTITION BY projectId, name ORDER BY qualifiedName, id) = 1)
SELECT ext AS sourceId, base AS targetId, 'extends' AS kind, CAST(NULL AS VARCHAR) AS metadata FROM pairs
UNION ALL SELECT DISTINCT p.base, coalesce(t.id, u.id), 'conformsTo', '{"via_extension":true}' FROM pairs p JOIN clauses c ON c.id = p.ext LEFT JOIN protocols t ON t.projectId = p.projectId AND t.name = c.name
LEFT JOIN protocols u ON u.projectId = 1 AND u.name = c.name WHERE coalesce(t.id, u.id) IS NOT NULL""",
    "resolve_conformances": _S
    + """, types AS (SELECT projectId, name, id, kind FROM real WHERE kind IN ('struct', 'class', 'enum', 'actor', 'protocol') QUALIFY row_number() OVER (PARTITION BY projectId, name ORDER BY qualifiedName, id) = 1)
SELECT DISTINCT c.id AS sourceId, coalesce(t.id, u.id) AS targetId, CASE WHEN c.kind = 'class' AND coalesce(t.kind, u.kind) = 'class' THEN 'inherits' ELSE 'conformsTo' END AS kind FROM clauses c LEFT JOIN types t ON t.projectId = c.projectId AND t.name = c.name
LEFT JOIN types u ON u.projectId = 1 AND u.name = c.name WHERE c.kind IN ('struct', 'class', 'enum', 'actor', 'protocol') AND c.id <> coalesce(t.id, u.id) AND c.id IN (SELECT id FROM real)""",
}
