"""Registered queries of the code graph, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import resolve
from symloom.operators.paths import inner_path, longest_prefix
from symloom.operators.records import cascade, first_writer_wins, last_writer_wins, set_null, unique_by
from symloom.operators.snapshots import trimmed
from symloom.plans import questions as ask
from symloom.plans.graph import Graph
from symloom.sources.files import file_states, latest_hashes
from symloom.sources.tables import table


def _graph(question):
    """A query from a question that needs nothing but the graph."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return question(Graph.read(spark, folder))

    query.__name__, query.__doc__ = question.__name__, question.__doc__
    return query


def _searchers(graph: Graph) -> DataFrame:
    """The symbols that searches start from: every id divisible by 20, against all rows."""
    return graph.symbols.where("id % 20 = 0").select(F.col("id").alias("seed")).distinct()


def read_symbol(spark: SparkSession, folder: str) -> DataFrame:
    return ask.read_symbol(Graph.read(spark, folder), table(spark, folder, "source_files"), table(spark, folder, "file_hashes"))


def usage_context(spark: SparkSession, folder: str) -> DataFrame:
    return ask.usage_context(ask.find_usages(Graph.read(spark, folder)), table(spark, folder, "source_files"))


def search_attribute(spark: SparkSession, folder: str) -> DataFrame:
    return ask.search(Graph.read(spark, folder), kind="class", attribute="MainActor")


def search_module(spark: SparkSession, folder: str) -> DataFrame:
    return ask.search(Graph.read(spark, folder), module="TrellisUI")


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    return ask.search_text(graph, graph.symbols.where("id % 20 = 0").select(F.col("name").alias("query")))


def search_text_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same searches, of which only the classes are reported."""
    graph = Graph.read(spark, folder)
    return ask.search_text(graph, graph.symbols.where("id % 20 = 0").select(F.col("name").alias("query")), kind="class")


def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    rows = graph.symbols.where("id IS NOT NULL")
    return ask.lookup(graph, rows.select("projectId", F.col("name").alias("query")).unionByName(rows.select("projectId", F.col("qualifiedName").alias("query"))))


def function_lookup(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    rows = graph.symbols.where("kind IN ('function', 'initializer')")
    return ask.lookup_functions(graph, rows.select("projectId", F.col("name").alias("query")).unionByName(rows.select("projectId", F.col("qualifiedName").alias("query"))))


def diff_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between the first and the second snapshot of all projects, by name, kind and parent."""
    rows = table(spark, folder, "symbol_snapshots").select("projectId", "snapshotNo", "name", "kind", F.regexp_extract("qualifiedName", r"^(.*)\.[^.]*$", 1).alias("parent"), "signature")
    return ask.diff_symbols(rows.where("snapshotNo = 1"), rows.where("snapshotNo = 2"))


def enrich_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Every usr of the index, taken away and found again from a compiler's definitions made of it."""
    symbols = unique_by(table(spark, folder, "symbols"), ["id"])
    defined = symbols.where("usr IS NOT NULL AND filePath IS NOT NULL").select("filePath", "line", F.col("usr").alias("symbolUSR"), F.concat("name", F.lit("()")).alias("symbolName"), F.array(F.lit("definition")).alias("roles"))
    return resolve.enrich_symbols(symbols.withColumn("usr", F.lit(None).cast("string")), defined).where("usr IS NOT NULL").select(F.col("id").alias("symbol_id"), "usr")


def compiler_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, overrides and requirements from a compiler's occurrences, which are made of the edges between symbols with a usr."""
    graph = Graph.read(spark, folder)
    named = graph.nodes("usr", "name").where("usr IS NOT NULL")
    roles = F.create_map(F.lit("calls"), F.lit("calledBy"), F.lit("overrides"), F.lit("overrideOf"), F.lit("implementsRequirement"), F.lit("baseOf"))
    turned = F.col("kind").isin("calls", "implementsRequirement")
    ends = graph.links("calls", "overrides", "implementsRequirement").join(named.select(F.col("id").alias("sourceId"), F.col("usr").alias("a")), "sourceId").join(named.select(F.col("id").alias("targetId"), F.col("usr").alias("b")), "targetId")
    seen = ends.select(
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("symbolUSR"), F.array(F.when(F.col("kind") == "calls", "call").otherwise("definition")).alias("roles"),
        F.array(F.struct(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("usr"), F.array(roles[F.col("kind")]).alias("roles"))).alias("relations"),
    )
    return resolve.compiler_edges(named, seen)


def impact_incoming(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    return ask.impact(graph, _searchers(graph))


def impact_outgoing(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    return ask.impact(graph, _searchers(graph), incoming=False)


def call_graph_callers(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    return ask.call_graph(graph, graph.nodes().withColumnRenamed("id", "seed"))


def call_graph_callees(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph.read(spark, folder)
    return ask.call_graph(graph, graph.nodes().withColumnRenamed("id", "seed"), callers=False)


def near_dead_code(spark: SparkSession, folder: str) -> DataFrame:
    return ask.dead_code(Graph.read(spark, folder), max_references=2)


def test_coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ask.test_coverage_summary(ask.test_coverage(Graph.read(spark, folder)))


def module_api_internal(spark: SparkSession, folder: str) -> DataFrame:
    return ask.module_api(Graph.read(spark, folder), "internal")


def rename_sites(spark: SparkSession, folder: str) -> DataFrame:
    """The sites of every symbol; the other overriders of a base are those of its class in ``override_classes``."""
    return ask.rename_sites(Graph.read(spark, folder), siblings=False)


def edges_first_writer_wins(spark: SparkSession, folder: str) -> DataFrame:
    return first_writer_wins(table(spark, folder, "edges"), trimmed("kind"))


def edges_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Edge rows that outlive their ends, repeats and all."""
    graph = Graph.read(spark, folder)
    return cascade(graph.edges, graph.symbols).select("id", "projectId", "sourceId", "targetId", trimmed("kind").alias("kind"), "metadata")


def symbols_set_null(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols whose module is no module of the index any more have none."""
    symbols = unique_by(table(spark, folder, "symbols"), ["id"], "moduleId")
    modules = table(spark, folder, "modules").where("kind <> 'executable'")
    return set_null(symbols, "moduleId", modules).select(F.col("id").alias("symbol_id"), F.col("moduleId").alias("module_id"))


def snapshots_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "symbol_snapshots").withColumn("qualifiedName", trimmed("qualifiedName"))
    return last_writer_wins(rows, ["projectId", "qualifiedName"], ["snapshotNo", "deliveredAt", "id"], ["name"], ["kind", "signature", "line"])


def hashes_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_hashes(table(spark, folder, "file_hashes"))


def incremental_states(spark: SparkSession, folder: str) -> DataFrame:
    return file_states(table(spark, folder, "source_files"), table(spark, folder, "file_hashes"))


def file_module_longest_prefix(spark: SparkSession, folder: str) -> DataFrame:
    roots = unique_by(table(spark, folder, "projects"), ["id"], "rootPath").select(F.col("id").alias("projectId"), "rootPath")
    folders = table(spark, folder, "modules").join(roots, "projectId").select("projectId", F.col("id").alias("moduleId"), F.concat("rootPath", F.lit("/"), "path").alias("folder"))
    return longest_prefix(table(spark, folder, "source_files"), folders)


def file_module_inner_path(spark: SparkSession, folder: str) -> DataFrame:
    return inner_path(table(spark, folder, "symbols"), table(spark, folder, "modules"))


QUERIES = {
    "read_symbol": read_symbol, "search_attribute": search_attribute, "search_module": search_module, "search_text": search_text, "search_text_filtered": search_text_filtered, "symbol_lookup": symbol_lookup,
    "symbol_relations": _graph(ask.symbol_relations), "symbols_in_file": _graph(ask.symbols_in_file), "edge_usages": _graph(ask.find_usages), "usage_context": usage_context,
    "find_conformers": _graph(ask.find_conformers), "protocol_coverage": _graph(ask.protocol_coverage), "protocol_impact": _graph(ask.protocol_impact), "dependencies": _graph(ask.dependencies),
    "impact_incoming": impact_incoming, "impact_outgoing": impact_outgoing, "call_graph_callers": call_graph_callers, "call_graph_callees": call_graph_callees, "view_trees": _graph(ask.view_trees),
    "dead_code": _graph(ask.dead_code), "near_dead_code": near_dead_code, "access_audit": _graph(ask.access_audit), "test_coverage": _graph(ask.test_coverage), "test_coverage_summary": test_coverage_summary,
    "cross_module_usage": _graph(ask.cross_module_usage), "module_graph": _graph(ask.module_graph), "module_api": _graph(ask.module_api), "module_api_internal": module_api_internal,
    "architecture": _graph(ask.architecture), "top_protocols": _graph(ask.top_protocols), "list_extensions": _graph(ask.list_extensions), "rename_sites": rename_sites, "override_classes": _graph(ask.override_classes),
    "parent_types": _graph(ask.parent_types), "function_lookup": function_lookup, "diff_snapshots": diff_snapshots, "enrich_symbols": enrich_symbols, "compiler_edges": compiler_edges,
    "edges_first_writer_wins": edges_first_writer_wins, "edges_cascade": edges_cascade, "symbols_set_null": symbols_set_null, "snapshots_upsert": snapshots_upsert,
    "hashes_latest": hashes_latest, "incremental_states": incremental_states, "file_module_longest_prefix": file_module_longest_prefix, "file_module_inner_path": file_module_inner_path,
}

_G = """WITH RECURSIVE s AS (SELECT DISTINCT * FROM symbols UNION SELECT * FROM shared_symbols),
e AS (SELECT id, projectId, sourceId, targetId, k AS kind, metadata FROM (SELECT *, trim(kind) AS k, row_number() OVER (PARTITION BY sourceId, targetId, trim(kind) ORDER BY id, metadata NULLS FIRST, projectId) AS rn FROM edges) q
  WHERE rn = 1 AND sourceId IN (SELECT id FROM s) AND targetId IN (SELECT id FROM s)),
placed AS (SELECT s.*, coalesce(s.moduleId, mf.id) AS module_id, coalesce(m.name, CASE WHEN s.moduleId IS NULL THEN mf.name END) AS module FROM s LEFT JOIN (SELECT DISTINCT * FROM modules) m ON m.id = s.moduleId
  LEFT JOIN (SELECT DISTINCT * FROM modules) mf ON mf.projectId = s.projectId AND s.moduleId IS NULL AND mf.path IS NOT NULL AND contains(lower(s.filePath), '/' || lower(mf.path) || '/'))"""


def _walk(start: str, step: str, depth: int, first: str = "SELECT seed, seed AS node, 0 AS depth FROM start", least: int = 0) -> str:
    """Least depth per (seed, node), and as parent the least node one level up."""
    return (
        f"""{_G}, start AS ({start}), step AS ({step}),
reach AS ({first} UNION SELECT r.seed, t.to_id, r.depth + 1 FROM reach r JOIN step t ON t.from_id = r.node WHERE r.depth < {depth}),
best AS (SELECT seed, node, min(depth) AS depth FROM reach WHERE depth >= {least} GROUP BY 1, 2),
tree AS (SELECT b.seed, b.node, CAST(b.depth AS INT) AS depth, CASE WHEN b.depth = 0 THEN NULL WHEN b.depth = 1 THEN b.seed ELSE min(p.node) END AS parent
  FROM best b LEFT JOIN step t ON t.to_id = b.node LEFT JOIN best p ON p.seed = b.seed AND p.node = t.from_id AND p.depth = b.depth - 1 GROUP BY b.seed, b.node, b.depth)
SELECT seed, node, depth, parent FROM tree"""
    )


_SEEDS = "SELECT DISTINCT id AS seed FROM s WHERE id % 20 = 0"
_CARRIES = "SELECT DISTINCT {a} AS from_id, {b} AS to_id FROM e WHERE kind NOT IN ('contains', 'imports', 'dependsOn') AND {b} IN (SELECT id FROM s WHERE kind NOT IN ('file', 'module'))"
_INNER_SEEDS = _SEEDS + " AND kind NOT IN ('file', 'module')"
_FROM_NEIGHBOURS = "SELECT seed, to_id AS node, 1 AS depth FROM start JOIN step ON from_id = seed"
_TESTS = "(moduleId IN (SELECT id FROM modules WHERE kind = 'test') OR coalesce(contains(lower(filePath), '/tests/'), false))"
_OUTSIDE = "NOT coalesce(contains(lower(filePath), '/tests/') OR ends_with(lower(filePath), 'tests.swift'), false)"
_DEAD = (
    _G
    + """, refs AS (SELECT targetId, count(*) FILTER (kind NOT IN ('extends', 'contains')) AS n, count(*) FILTER (kind = 'contains') AS parents FROM e GROUP BY 1)
SELECT s.id AS symbol_id, s.name, s.kind, coalesce(r.n, 0) AS n_references FROM s LEFT JOIN refs r ON r.targetId = s.id
WHERE s.kind IN ('struct', 'class', 'enum', 'actor', 'function', 'typeAlias') AND NOT starts_with(lower(qualifiedName), 'unresolved:') AND coalesce(r.parents, 0) = 0
  AND NOT coalesce(contains(lower(attributes), '@main'), false) AND s.id NOT IN (SELECT sourceId FROM e WHERE kind = 'conformsTo') AND coalesce(moduleId NOT IN (SELECT id FROM modules WHERE kind = 'test'), true)
  AND """
    + _OUTSIDE
    + " AND coalesce(r.n, 0) <= {}"
)
_COVERAGE = (
    _G
    + f""", classes AS (SELECT projectId, CASE WHEN ends_with(name, 'Tests') THEN left(name, length(name) - 5) WHEN ends_with(name, 'Test') OR ends_with(name, 'Spec') THEN left(name, length(name) - 4) END AS about,
  CASE WHEN ends_with(name, 'Tests') THEN 3 WHEN ends_with(name, 'Test') THEN 2 ELSE 1 END AS rank, name FROM s WHERE kind IN ('struct', 'class') AND {_TESTS}),
named AS (SELECT projectId, about, name AS test FROM classes WHERE about <> '' QUALIFY row_number() OVER (PARTITION BY projectId, about ORDER BY rank DESC, name DESC) = 1),
referenced AS (SELECT DISTINCT t.projectId, t.name FROM e JOIN s f ON f.id = e.sourceId JOIN s t ON t.id = e.targetId WHERE e.kind = 'references' AND (f.moduleId IN (SELECT id FROM modules WHERE kind = 'test') OR coalesce(contains(lower(f.filePath), '/tests/'), false))),
covered AS (SELECT s.id AS symbol_id, s.projectId AS project_id, s.name, coalesce(contains(s.inheritedTypes, '"View"'), false) AS is_view, coalesce(n.test, CASE WHEN r.name IS NOT NULL THEN '(referenced)' END) AS tested_by
  FROM s LEFT JOIN named n ON n.projectId = s.projectId AND n.about = s.name LEFT JOIN referenced r ON r.projectId = s.projectId AND r.name = s.name
  WHERE s.kind IN ('struct', 'class', 'enum', 'actor', 'protocol') AND s.name <> 'CodingKeys' AND NOT {_TESTS.replace('moduleId', 'coalesce(moduleId, -1)')})"""
)
_API = (
    _G
    + """, top AS (SELECT module_id, id, kind FROM placed WHERE module_id IS NOT NULL AND accessLevel IN ({levels}) AND kind IN ('struct', 'class', 'enum', 'actor', 'protocol', 'function', 'variable', 'typeAlias') AND NOT starts_with(lower(qualifiedName), 'unresolved:'))
SELECT module_id, id AS symbol_id, CASE kind WHEN 'function' THEN 'function' WHEN 'variable' THEN 'variable' ELSE 'type' END AS section, CAST(NULL AS BIGINT) AS owner_id FROM top
UNION ALL SELECT t.module_id, m.id, 'member', t.id FROM top t JOIN e ON e.sourceId = t.id AND e.kind = 'contains' JOIN s m ON m.id = e.targetId
WHERE t.kind IN ('struct', 'class', 'enum', 'actor', 'protocol') AND m.kind IN ('function', 'variable', 'initializer', 'typeAlias', 'enum', 'struct') AND (m.accessLevel IS NULL OR m.accessLevel IN ({levels}))"""
)
_CONFORMERS = "SELECT e.targetId AS protocol_id, c.id AS conformer_id, c.name AS conformer_name, c.kind AS conformer_kind FROM e JOIN s p ON p.id = e.targetId AND p.kind = 'protocol' JOIN s c ON c.id = e.sourceId WHERE e.kind = 'conformsTo'"
_MET = f""", conf AS ({_CONFORMERS}), needed AS (SELECT c.protocol_id, c.conformer_id, r.id AS requirement_id, r.name AS requirement_name FROM conf c JOIN e ON e.kind = 'contains' AND e.sourceId = c.protocol_id JOIN s r ON r.id = e.targetId),
has AS (SELECT e.sourceId AS conformer_id, m.name FROM e JOIN s m ON m.id = e.targetId WHERE e.kind = 'contains' UNION SELECT x.targetId, m.name FROM e x JOIN e ON e.sourceId = x.sourceId AND e.kind = 'contains' JOIN s m ON m.id = e.targetId WHERE x.kind = 'extends'),
met AS (SELECT n.*, h.name IS NOT NULL AS satisfied FROM needed n LEFT JOIN has h ON h.conformer_id = n.conformer_id AND h.name = n.requirement_name)"""
_USAGES = (
    _G
    + """, sites AS (SELECT e.targetId AS symbol_id, coalesce(u.filePath, '') AS file_path, coalesce(u.line, 0) AS line, u.name AS used_by, u.kind AS used_by_kind, CASE WHEN e.kind = 'references' THEN 'type reference' ELSE e.kind END AS context,
  row_number() OVER (PARTITION BY e.targetId, coalesce(u.filePath, ''), coalesce(u.line, 0) ORDER BY e.kind <> 'references', e.kind, u.name, u.id) AS rn FROM e JOIN s u ON u.id = e.sourceId WHERE e.kind NOT IN ('contains', 'extends')),
usages AS (SELECT symbol_id, file_path, line, used_by, used_by_kind, context FROM sites WHERE rn = 1)"""
)
_LINES = "string_split(regexp_replace(f.content, '\r\n?', '\n', 'g'), '\n')"
_FILES = "(SELECT projectId, filePath, max(content) AS content FROM source_files GROUP BY 1, 2)"
_STATES = """WITH now AS (SELECT projectId, filePath, max(content) AS content FROM source_files GROUP BY 1, 2),
stored AS (SELECT projectId, filePath, sha256 FROM file_hashes QUALIFY row_number() OVER (PARTITION BY projectId, filePath ORDER BY lastIndexed DESC NULLS LAST, id DESC, sha256 DESC) = 1),
states AS (SELECT coalesce(n.projectId, h.projectId) AS projectId, coalesce(n.filePath, h.filePath) AS filePath, CASE WHEN n.filePath IS NULL THEN 'deleted' WHEN n.content IS NULL THEN 'unreadable' WHEN h.sha256 IS NULL THEN 'new'
  WHEN sha256(n.content) = h.sha256 THEN 'same' ELSE 'changed' END AS state FROM now n FULL JOIN stored h ON h.projectId = n.projectId AND h.filePath = n.filePath)"""

_SEARCH = (
    _G
    + """, docs AS (SELECT id, list_filter(regexp_split_to_array(lower(name || ' ' || qualifiedName), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM s),
postings AS (SELECT id, len(tokens) AS length, unnest(tokens) AS token FROM docs), size AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs),
asked AS (SELECT DISTINCT name AS query, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS terms FROM s WHERE id % 20 = 0),
terms AS (SELECT query, len(terms) AS n_terms, unnest(terms) AS term FROM asked),
known AS (SELECT DISTINCT t.term, p.token FROM (SELECT DISTINCT term FROM terms) t JOIN (SELECT DISTINCT token FROM postings) p ON starts_with(p.token, t.term)),
hits AS (SELECT k.term, p.id, p.length, count(*) AS tf FROM known k JOIN postings p ON p.token = k.token GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
scored AS (SELECT t.query, h.id, round(-sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * h.length / mean))), 9) AS score
  FROM terms t JOIN hits h ON h.term = t.term JOIN df ON df.term = t.term CROSS JOIN size GROUP BY t.query, h.id, t.n_terms HAVING count(*) = t.n_terms),
listed AS (SELECT id FROM s WHERE {})
SELECT query, id AS symbol_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score, id) AS INT) AS place FROM scored WHERE id IN (SELECT id FROM listed) QUALIFY place <= 20"""
)

ORACLES = {
    "read_symbol": _STATES
    + f""", s AS (SELECT DISTINCT * FROM symbols), cut AS (SELECT s.id, greatest(s.line, 1) AS a, least(coalesce(s.endLine, s.line), len({_LINES})) AS b, {_LINES} AS lines, t.state
  FROM s LEFT JOIN now f ON f.projectId = s.projectId AND f.filePath = s.filePath LEFT JOIN states t ON t.projectId = s.projectId AND t.filePath = s.filePath WHERE s.filePath IS NOT NULL AND s.line IS NOT NULL)
SELECT id AS symbol_id, CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string([format('{{:4d}} | {{}}', i, lines[i]) FOR i IN range(a, b + 1)], '\n'), '') END AS source, coalesce(state = 'changed', false) AS stale FROM cut""",
    "search_attribute": _G + "\nSELECT id AS symbol_id, name, kind, module FROM placed WHERE kind = 'class' AND contains(attributes, '\"@MainActor\"') AND NOT starts_with(qualifiedName, 'unresolved:')",
    "search_module": _G + "\nSELECT id AS symbol_id, name, kind, module FROM placed WHERE module = 'TrellisUI' AND NOT starts_with(qualifiedName, 'unresolved:')",
    "symbol_lookup": _G
    + """, asked AS (SELECT projectId, name AS query FROM s UNION SELECT projectId, qualifiedName FROM s),
means AS (SELECT projectId, name AS query, 1 AS rank, qualifiedName, id FROM s WHERE kind NOT IN ('extension', 'file', 'module') AND NOT starts_with(lower(qualifiedName), 'unresolved:')
  UNION ALL SELECT projectId, qualifiedName, 2, qualifiedName, id FROM s UNION ALL SELECT projectId, name, 3, qualifiedName, id FROM s WHERE kind = 'extension')
SELECT a.projectId AS project_id, a.query, m.id AS symbol_id, CASE m.rank WHEN 1 THEN 'name' WHEN 2 THEN 'qualified' ELSE 'extension' END AS how FROM asked a JOIN means m ON m.projectId = a.projectId AND m.query = a.query
QUALIFY row_number() OVER (PARTITION BY a.projectId, a.query ORDER BY m.rank, m.qualifiedName, m.id) = 1""",
    "search_text": _SEARCH.format("NOT starts_with(lower(qualifiedName), 'unresolved:')"),
    "search_text_filtered": _SEARCH.format("NOT starts_with(lower(qualifiedName), 'unresolved:') AND kind = 'class'"),
    "symbol_relations": _G
    + """, seen AS (SELECT DISTINCT CASE WHEN kind = 'extends' THEN targetId ELSE sourceId END AS symbol_id, CASE WHEN kind = 'contains' THEN 'member' WHEN kind = 'extends' THEN 'extension' ELSE 'conformance' END AS section,
  CASE WHEN kind = 'extends' THEN sourceId ELSE targetId END AS other_id FROM e WHERE kind IN ('contains', 'conformsTo', 'inherits', 'extends'))
SELECT symbol_id, section, other_id, s.name AS other_name, s.kind AS other_kind FROM seen JOIN s ON s.id = other_id""",
    "symbols_in_file": _G
    + "\nSELECT filePath AS file_path, CAST(row_number() OVER (PARTITION BY filePath ORDER BY line NULLS FIRST, name, id) AS INT) AS place, id AS symbol_id, kind, name FROM s WHERE filePath IS NOT NULL AND NOT starts_with(lower(qualifiedName), 'unresolved:') AND NOT starts_with(lower(qualifiedName), 'file:')",
    "edge_usages": _USAGES + "\nSELECT * FROM usages",
    "usage_context": _USAGES
    + f""", files AS (SELECT filePath, max(content) AS content FROM source_files GROUP BY 1), cut AS (SELECT u.symbol_id, u.file_path, u.line, {_LINES} AS lines FROM usages u JOIN files f ON f.filePath = u.file_path WHERE u.line > 0)
SELECT symbol_id, file_path, line, CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string([format('{{}}{{:4d}} | {{}}', CASE WHEN i = line THEN '>' ELSE ' ' END, i, lines[i]) FOR i IN range(greatest(line - 1, 1), least(line + 1, len(lines)) + 1)], '\n'), '') END AS source FROM cut""",
    "find_conformers": _G + "\n" + _CONFORMERS,
    "protocol_coverage": _G + _MET + "\nSELECT protocol_id, conformer_id, requirement_id, requirement_name, satisfied FROM met",
    "protocol_impact": _G + _MET + "\nSELECT c.protocol_id, count(DISTINCT c.conformer_id) AS n_conformers, any_value(coalesce(m.r, 0)) AS n_requirements, any_value(coalesce(m.ok, 0)) AS n_satisfied FROM conf c LEFT JOIN (SELECT protocol_id, count(DISTINCT requirement_id) AS r, count(*) FILTER (satisfied) AS ok FROM met GROUP BY 1) m ON m.protocol_id = c.protocol_id GROUP BY 1",
    "dependencies": _G + "\nSELECT e.sourceId AS symbol_id, 'outgoing' AS direction, e.kind AS edge_kind, o.id AS other_id, o.name AS other_name FROM e JOIN s o ON o.id = e.targetId UNION ALL SELECT e.targetId, 'incoming', e.kind, o.id, o.name FROM e JOIN s o ON o.id = e.sourceId",
    "impact_incoming": _walk(_INNER_SEEDS, _CARRIES.format(a="targetId", b="sourceId"), 5),
    "impact_outgoing": _walk(_INNER_SEEDS, _CARRIES.format(a="sourceId", b="targetId"), 5),
    "call_graph_callers": _walk("SELECT DISTINCT id AS seed FROM s", "SELECT DISTINCT targetId AS from_id, sourceId AS to_id FROM e WHERE kind = 'calls'", 5, _FROM_NEIGHBOURS, 1),
    "call_graph_callees": _walk("SELECT DISTINCT id AS seed FROM s", "SELECT DISTINCT sourceId AS from_id, targetId AS to_id FROM e WHERE kind = 'calls'", 5, _FROM_NEIGHBOURS, 1),
    "view_trees": _walk("SELECT DISTINCT sourceId AS seed FROM e WHERE kind = 'composesView' AND sourceId NOT IN (SELECT targetId FROM e WHERE kind = 'composesView')", "SELECT DISTINCT sourceId AS from_id, targetId AS to_id FROM e WHERE kind = 'composesView'", 10).replace("SELECT seed, node, depth, parent FROM tree", "SELECT seed AS root, node, depth, parent FROM tree"),
    "dead_code": _DEAD.format(0),
    "near_dead_code": _DEAD.format(2),
    "access_audit": _G
    + f""", used AS (SELECT e.targetId, min(f.filePath) AS low, max(f.filePath) AS high FROM e JOIN s f ON f.id = e.sourceId WHERE e.kind NOT IN ('contains', 'extends') AND f.filePath IS NOT NULL GROUP BY 1),
seen AS (SELECT s.id, accessLevel AS access, low IS NULL AS unused, low = filePath AND high = filePath AS own FROM s LEFT JOIN used u ON u.targetId = s.id
  WHERE accessLevel IN ('public', 'open', 'internal') AND kind IN ('struct', 'class', 'enum', 'actor', 'protocol', 'function', 'variable', 'typeAlias') AND filePath IS NOT NULL AND NOT starts_with(lower(qualifiedName), 'unresolved:') AND {_OUTSIDE}
  AND s.id NOT IN (SELECT sourceId FROM e WHERE kind = 'implementsRequirement'))
SELECT id AS symbol_id, access, CASE WHEN access = 'internal' THEN 'private' WHEN unused THEN 'internal' ELSE 'fileprivate' END AS suggested,
  CASE WHEN unused THEN 'unused' ELSE 'one_file' END AS reason FROM seen WHERE unused OR own""",
    "test_coverage": _COVERAGE + "\nSELECT * FROM covered",
    "test_coverage_summary": _COVERAGE
    + """
SELECT *, round(CASE WHEN n_types > 0 THEN 100.0 * n_tested / n_types ELSE 0 END, 6) AS percent, round(CASE WHEN n_logic > 0 THEN 100.0 * n_logic_tested / n_logic ELSE 0 END, 6) AS logic_percent FROM (SELECT project_id, count(*) AS n_types, count(tested_by) AS n_tested,
  count(*) FILTER (NOT is_view) AS n_logic, count(tested_by) FILTER (NOT is_view) AS n_logic_tested FROM covered GROUP BY 1) c""",
    "cross_module_usage": _G
    + """
SELECT f.module_id, t.module_id AS target_module_id, e.targetId AS target_id, count(*) AS n_uses FROM e JOIN placed f ON f.id = e.sourceId JOIN placed t ON t.id = e.targetId
WHERE e.kind = 'references' AND t.kind IN ('struct', 'class', 'enum', 'actor', 'protocol', 'typeAlias') AND f.module_id <> t.module_id GROUP BY 1, 2, 3""",
    "module_graph": _G + "\nSELECT f.moduleId AS module_id, t.moduleId AS dependency_id, count(*) AS n_imports FROM e JOIN s f ON f.id = e.sourceId JOIN s t ON t.id = e.targetId WHERE e.kind = 'imports' AND f.moduleId <> t.moduleId GROUP BY 1, 2",
    "module_api": _API.format(levels="'public', 'open'"),
    "module_api_internal": _API.format(levels="'public', 'open', 'internal'"),
    "architecture": _G
    + """
SELECT p.id AS project_id, (SELECT count(DISTINCT m.id) FROM modules m WHERE m.projectId = p.id) AS n_modules, count(*) FILTER (s.kind = 'protocol') AS n_protocols,
  count(*) FILTER (s.kind IN ('class', 'struct') AND (ends_with(lower(s.name), 'viewmodel') OR contains(lower(s.attributes), '@observable'))) AS n_view_models, count(*) FILTER (s.kind = 'file') AS n_files, count(s.id) AS n_symbols
FROM (SELECT DISTINCT id FROM projects) p LEFT JOIN s ON s.projectId = p.id GROUP BY p.id""",
    "top_protocols": _G
    + """
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n_conformers DESC, protocol) AS INT) AS place, protocol, n_conformers
FROM (SELECT p.projectId AS project_id, p.name AS protocol, count(*) AS n_conformers FROM e JOIN s p ON p.id = e.targetId AND p.kind = 'protocol' WHERE e.kind = 'conformsTo' GROUP BY 1, 2) c QUALIFY place <= 20""",
    "list_extensions": _G
    + """, held AS (SELECT sourceId, count(*) AS n FROM e WHERE kind = 'contains' GROUP BY 1),
pairs AS (SELECT DISTINCT e.targetId AS type_id, x.id AS extension_id, list_distinct(from_json(x.inheritedTypes, '["VARCHAR"]')) AS added FROM e JOIN s x ON x.id = e.sourceId WHERE e.kind = 'extends')
SELECT type_id, extension_id, conformance, coalesce(h.n, 0) AS n_members FROM (SELECT type_id, extension_id, unnest(CASE WHEN len(added) > 0 THEN added ELSE [NULL] END) AS conformance FROM pairs) p LEFT JOIN held h ON h.sourceId = extension_id""",
    "rename_sites": _G
    + """, named AS (SELECT * FROM s WHERE kind NOT IN ('file', 'module') AND NOT starts_with(lower(qualifiedName), 'unresolved:')),
types AS (SELECT * FROM named WHERE kind IN ('struct', 'class', 'enum', 'actor', 'protocol', 'typeAlias')),
sites AS (SELECT id AS symbol_id, id AS at_id, 1 AS rank, 'declaration' AS category FROM named
  UNION ALL SELECT targetId, sourceId, 2, 'type reference' FROM e WHERE kind = 'references'
  UNION ALL SELECT t.id, i.id, 3, 'inheritance' FROM types t JOIN (SELECT projectId, id, unnest(list_distinct(from_json(inheritedTypes, '["VARCHAR"]'))) AS name FROM named) i ON i.projectId = t.projectId AND i.name = t.name
  UNION ALL SELECT t.id, x.id, 4, 'extension' FROM types t JOIN named x ON x.kind = 'extension' AND x.projectId = t.projectId AND x.name = t.name
  UNION ALL SELECT targetId, sourceId, 5, 'function call' FROM e WHERE kind = 'calls'
  UNION ALL SELECT targetId, sourceId, 6, 'protocol implementation' FROM e WHERE kind = 'implementsRequirement' AND targetId IN (SELECT c.targetId FROM e c JOIN s p ON p.id = c.sourceId AND p.kind = 'protocol' WHERE c.kind = 'contains')
  UNION ALL SELECT sourceId, targetId, 8, 'overridden base' FROM e WHERE kind = 'overrides')
SELECT symbol_id, p.filePath AS file_path, p.line, category FROM sites JOIN s p ON p.id = at_id WHERE p.filePath IS NOT NULL AND p.line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id, p.filePath, p.line ORDER BY rank) = 1""",
    "override_classes": _G + "\nSELECT e.targetId AS base_id, e.sourceId AS symbol_id, count(*) OVER (PARTITION BY e.targetId) AS n_overriders FROM e WHERE kind = 'overrides'",
    "parent_types": _G + "\nSELECT e.targetId AS symbol_id, p.id AS parent_id, p.name AS parent_name FROM e JOIN s p ON p.id = e.sourceId AND p.kind IN ('struct', 'class', 'enum', 'actor', 'protocol') WHERE e.kind = 'contains' QUALIFY row_number() OVER (PARTITION BY e.targetId ORDER BY p.name, p.id) = 1",
    "function_lookup": _G
    + """, callable AS (SELECT * FROM s WHERE kind IN ('function', 'initializer')), asked AS (SELECT projectId, name AS query FROM callable UNION SELECT projectId, qualifiedName FROM callable),
means AS (SELECT projectId, name AS query, 'function' AS how, 1 AS rank, qualifiedName, id FROM callable WHERE kind = 'function' UNION ALL SELECT projectId, CASE WHEN i = 0 THEN name ELSE 'init' END, 'initializer', 2, qualifiedName, id FROM callable, range(2) r(i) WHERE kind = 'initializer'
  UNION ALL SELECT projectId, qualifiedName, 'qualified', 3, qualifiedName, id FROM callable WHERE kind = 'function' UNION ALL SELECT projectId, regexp_extract(qualifiedName, '[^.]*$'), 'member', 4, qualifiedName, id FROM callable)
SELECT a.projectId AS project_id, a.query, m.id AS symbol_id, m.how FROM asked a JOIN means m ON m.projectId = a.projectId AND m.query = a.query QUALIFY row_number() OVER (PARTITION BY a.projectId, a.query ORDER BY m.rank, m.qualifiedName, m.id) = 1""",
    "diff_snapshots": """WITH r AS (SELECT projectId, snapshotNo, name, kind, regexp_extract(qualifiedName, '^(.*)\\.[^.]*$', 1) AS parent, max(coalesce(signature, '')) AS sig FROM symbol_snapshots WHERE snapshotNo IN (1, 2) GROUP BY ALL),
d AS (SELECT coalesce(a.projectId, b.projectId) AS projectId, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'modified' END AS section, coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, coalesce(a.parent, b.parent) AS parent
  FROM (SELECT * FROM r WHERE snapshotNo = 1) a FULL JOIN (SELECT * FROM r WHERE snapshotNo = 2) b ON a.projectId = b.projectId AND a.name = b.name AND a.kind = b.kind AND a.parent = b.parent WHERE a.sig IS DISTINCT FROM b.sig)
SELECT projectId, section, CAST(row_number() OVER (PARTITION BY projectId, section ORDER BY name, kind, parent) AS INT) AS place, name, kind, parent FROM d QUALIFY place <= 100""",
    "enrich_symbols": "SELECT DISTINCT s.id AS symbol_id, d.usr FROM symbols s JOIN (SELECT filePath, line, name, min(usr) AS usr FROM symbols WHERE usr IS NOT NULL GROUP BY 1, 2, 3) d ON d.filePath = s.filePath AND d.line = s.line AND d.name = s.name",
    "compiler_edges": _G
    + """, u AS (SELECT usr, min(id) AS id FROM s WHERE usr IS NOT NULL GROUP BY 1)
SELECT DISTINCT a.id AS sourceId, b.id AS targetId, e.kind, 'indexStore' AS metadata FROM e JOIN s x ON x.id = e.sourceId JOIN s y ON y.id = e.targetId JOIN u a ON a.usr = x.usr JOIN u b ON b.usr = y.usr WHERE e.kind IN ('calls', 'overrides', 'implementsRequirement') AND a.id <> b.id""",
    "edges_first_writer_wins": "SELECT id, projectId, sourceId, targetId, trim(kind) AS kind, metadata FROM edges QUALIFY row_number() OVER (PARTITION BY sourceId, targetId, trim(kind) ORDER BY id, metadata NULLS FIRST, projectId) = 1",
    "edges_cascade": "WITH ids AS (SELECT id FROM symbols UNION SELECT id FROM shared_symbols) SELECT id, projectId, sourceId, targetId, trim(kind) AS kind, metadata FROM edges WHERE sourceId IN (SELECT id FROM ids) AND targetId IN (SELECT id FROM ids)",
    "symbols_set_null": "SELECT DISTINCT s.id AS symbol_id, CASE WHEN m.id IS NOT NULL THEN s.moduleId END AS module_id FROM symbols s LEFT JOIN modules m ON m.id = s.moduleId AND m.kind <> 'executable'",
    "snapshots_upsert": """WITH h AS (SELECT projectId, trim(regexp_replace(qualifiedName, '^\\s+|\\s+$', '', 'g')) AS qualifiedName, snapshotNo, deliveredAt, id, name, kind, signature, line FROM symbol_snapshots),
ranked AS (SELECT *, row_number() OVER (PARTITION BY projectId, qualifiedName ORDER BY snapshotNo, deliveredAt, id, name) AS a, row_number() OVER (PARTITION BY projectId, qualifiedName ORDER BY snapshotNo DESC, deliveredAt DESC, id DESC, kind DESC, signature DESC NULLS LAST, line DESC NULLS LAST) AS b, count(*) OVER (PARTITION BY projectId, qualifiedName) AS n_writes FROM h)
SELECT l.projectId, l.qualifiedName, f.name, l.kind, l.signature, l.line, l.n_writes FROM ranked l JOIN ranked f ON f.projectId = l.projectId AND f.qualifiedName = l.qualifiedName AND f.a = 1 WHERE l.b = 1""",
    "hashes_latest": "SELECT projectId, filePath, sha256 FROM file_hashes QUALIFY row_number() OVER (PARTITION BY projectId, filePath ORDER BY lastIndexed DESC NULLS LAST, id DESC, sha256 DESC) = 1",
    "incremental_states": _STATES + "\nSELECT * FROM states",
    "file_module_longest_prefix": f"""SELECT f.projectId, f.filePath, q.moduleId FROM (SELECT DISTINCT projectId, filePath FROM source_files) f LEFT JOIN (SELECT g.projectId, g.filePath, m.id AS moduleId FROM (SELECT DISTINCT projectId, filePath FROM source_files) g
  JOIN projects p ON p.id = g.projectId JOIN modules m ON m.projectId = g.projectId AND starts_with(g.filePath, p.rootPath || '/' || m.path || '/') QUALIFY row_number() OVER (PARTITION BY g.projectId, g.filePath ORDER BY length(m.path) DESC, m.id) = 1) q
  ON q.projectId = f.projectId AND q.filePath = f.filePath""",
    "file_module_inner_path": "SELECT DISTINCT f.projectId, f.filePath, m.id AS moduleId FROM (SELECT DISTINCT projectId, filePath FROM symbols WHERE filePath IS NOT NULL) f JOIN modules m ON m.projectId = f.projectId AND contains(lower(f.filePath), '/' || lower(m.path) || '/')",
}
