"""Queries on hierarchies (p2), snapshots (p3) and heavy keys (p4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.heavy import distinct_per_key, heavy_keys, joined_states, key_states, roll_up
from symloom.operators.hierarchy import circles, descendants, hierarchy
from symloom.operators.snapshots import snapshot_changes, trimmed, validity_intervals, without_space
from symloom.session import cut
from symloom.sources.tables import table


def _contains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edges").where(trimmed("kind") == "contains").select("sourceId", "targetId")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(_contains(spark, folder), "targetId", "sourceId")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = hierarchy(_contains(spark, folder), "targetId", "sourceId", with_path=True)
    return found.select("node_id", "root_id", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(hierarchy(_contains(spark, folder), "targetId", "sourceId", with_path=True))


def p2_circles(spark: SparkSession, folder: str) -> DataFrame:
    return circles(_contains(spark, folder), "targetId", "sourceId")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "symbol_snapshots"))


def p3_intervals(spark: SparkSession, folder: str) -> DataFrame:
    intervals = validity_intervals(
        table(spark, folder, "symbol_snapshots"), "projectId", "snapshotNo", trimmed("qualifiedName"),
        [without_space("signature").alias("signature"), F.col("kind").alias("kind")], [F.col("deliveredAt"), F.col("id")],
    )
    return intervals.select(
        F.col("grp").alias("project_id"), F.col("key").alias("qualified_name"), F.col("state.kind").alias("kind"), F.col("state.signature").alias("signature"),
        F.col("first_no").alias("from_no"), F.col("next_no").alias("until_no"),
    )


def _target_states(spark: SparkSession, folder: str) -> DataFrame:
    return key_states(table(spark, folder, "edges"), [trimmed("kind").alias("kind"), F.col("targetId").alias("target_id")], {"n_metadata": F.col("metadata").isNotNull().cast("long")})


def _symbol_states(spark: SparkSession, folder: str) -> DataFrame:
    symbols = table(spark, folder, "symbols").select("id", "line").unionByName(table(spark, folder, "shared_symbols").select("id", "line"))
    return key_states(symbols, [F.col("id").alias("target_id")], {"lines": F.coalesce("line", F.lit(0)).cast("long")})


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """The heavy keys with their edges, and what these are when joined with the rows of their target symbol.

    The compact states are written once: the join and the total both read them, never the edges again.
    """
    states = cut(_target_states(spark, folder))
    joined = joined_states(states, _symbol_states(spark, folder), "target_id", ["n_metadata"], ["lines"], keep_lost=True)
    return heavy_keys(joined, 100, ["kind", "target_id"], states).select("kind", "target_id", F.col("n").alias("n_edges"), "n_joined", "joined_n_metadata", "joined_lines")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_report(spark, folder).select("kind", "target_id")


def p4_per_target(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "edges").select(trimmed("kind").alias("kind"), F.col("targetId").alias("target_id"), "sourceId")
    sources = distinct_per_key(edges, ["kind", "target_id"], "sourceId").withColumnRenamed("n_distinct", "n_sources")
    return _target_states(spark, folder).join(sources, ["kind", "target_id"], "left").select("kind", "target_id", F.col("n").alias("n_edges"), "n_metadata", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def p4_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Edges joined with the rows of their target symbol, per (kind, target), without the join's rows."""
    return joined_states(_target_states(spark, folder), _symbol_states(spark, folder), "target_id", ["n_metadata"], ["lines"]).select("kind", "target_id", "n_joined", "joined_n_metadata", "joined_lines")


def p4_joined_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return roll_up(p4_joined(spark, folder), ["kind"], ["n_joined", "joined_n_metadata", "joined_lines"])


QUERIES = {
    "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_circles": p2_circles,
    "p3_found": p3_found, "p3_intervals": p3_intervals,
    "p4_found": p4_found, "p4_report": p4_report, "p4_per_target": p4_per_target, "p4_joined": p4_joined, "p4_joined_by_kind": p4_joined_by_kind,
}

_LINKS = """WITH RECURSIVE ends AS (SELECT sourceId, targetId FROM edges WHERE trim(kind) = 'contains'),
links AS (SELECT targetId AS child, min(sourceId) AS parent FROM ends WHERE sourceId IS NOT NULL AND targetId IS NOT NULL GROUP BY 1),
nodes AS (SELECT sourceId AS id FROM ends UNION SELECT targetId FROM ends),
tree AS (SELECT id, id AS root, 0 AS depth, [id] AS path FROM nodes WHERE id IS NOT NULL AND id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, t.root, t.depth + 1, list_append(t.path, l.child) FROM tree t JOIN links l ON l.parent = t.id)"""

_STATES = """WITH named AS (SELECT projectId, snapshotNo, trim(regexp_replace(qualifiedName, '^\\s+|\\s+$', '', 'g')) AS name, kind,
    nullif(regexp_replace(signature, '\\s', '', 'g'), '') AS signature, deliveredAt, id FROM symbol_snapshots),
calendar AS (SELECT projectId, snapshotNo, lead(snapshotNo) OVER (PARTITION BY projectId ORDER BY snapshotNo) AS next_no, lag(snapshotNo) OVER (PARTITION BY projectId ORDER BY snapshotNo) AS last_no
    FROM (SELECT DISTINCT projectId, snapshotNo FROM symbol_snapshots) d),
state AS (SELECT n.projectId, n.snapshotNo, n.name, n.kind, n.signature, c.next_no, c.last_no
    FROM (SELECT *, row_number() OVER (PARTITION BY projectId, snapshotNo, name ORDER BY deliveredAt DESC NULLS LAST, id DESC) AS rn FROM named WHERE name <> '') n
    JOIN calendar c ON c.projectId = n.projectId AND c.snapshotNo = n.snapshotNo WHERE rn = 1)"""

ORACLES = {
    "p2_found": _LINKS + "\nSELECT n.id AS node_id, coalesce(t.root, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth FROM nodes n LEFT JOIN tree t ON t.id = n.id WHERE n.id IS NOT NULL",
    "p2_paths": _LINKS + "\nSELECT n.id AS node_id, coalesce(t.root, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth, coalesce(array_to_string(t.path, '/'), '') AS path FROM nodes n LEFT JOIN tree t ON t.id = n.id WHERE n.id IS NOT NULL",
    "p2_descendants": _LINKS + ", up AS (SELECT id, depth, unnest(path) AS above, generate_subscripts(path, 1) AS pos FROM tree)\nSELECT above AS ancestor_id, id AS node_id, CAST(depth - pos + 1 AS INT) AS distance FROM up WHERE above <> id",
    "p2_circles": _LINKS
    + """, lost AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT id FROM tree)),
reach AS (SELECT child AS origin, parent AS here FROM lost UNION SELECT r.origin, l.parent FROM reach r JOIN lost l ON l.child = r.here)
SELECT child AS node_id, CASE WHEN child IN (SELECT origin FROM reach WHERE origin = here) THEN 'on' ELSE 'below' END AS place FROM lost""",
    "p3_found": _STATES
    + """
SELECT b.projectId AS project_id, b.snapshotNo AS snapshot_no, b.name AS qualified_name, CASE WHEN a.name IS NULL THEN 'added' ELSE 'changed' END AS change
FROM state b LEFT JOIN state a ON a.projectId = b.projectId AND a.name = b.name AND a.snapshotNo = b.last_no
WHERE b.last_no IS NOT NULL AND (a.name IS NULL OR a.kind IS DISTINCT FROM b.kind OR a.signature IS DISTINCT FROM b.signature)
UNION ALL SELECT a.projectId, a.next_no, a.name, 'removed' FROM state a LEFT JOIN state b ON a.projectId = b.projectId AND a.name = b.name AND b.snapshotNo = a.next_no
WHERE a.next_no IS NOT NULL AND b.name IS NULL""",
    "p3_intervals": _STATES
    + """, marked AS (SELECT *, CASE WHEN lag(snapshotNo) OVER w IS NOT DISTINCT FROM last_no AND last_no IS NOT NULL AND lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(signature) OVER w IS NOT DISTINCT FROM signature THEN 0 ELSE 1 END AS starts
    FROM state WINDOW w AS (PARTITION BY projectId, name ORDER BY snapshotNo)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY projectId, name ORDER BY snapshotNo) AS island FROM marked)
SELECT projectId AS project_id, name AS qualified_name, any_value(kind) AS kind, any_value(signature) AS signature, min(snapshotNo) AS from_no, CAST(nullif(arg_max(coalesce(next_no, 0), snapshotNo), 0) AS INT) AS until_no
FROM islands GROUP BY projectId, name, island""",
    "p4_found": "SELECT trim(kind) AS kind, targetId AS target_id FROM edges WHERE kind IS NOT NULL AND targetId IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM edges)",
    "p4_report": """SELECT e.kind, e.target_id, e.n AS n_edges, e.n * coalesce(s.n, 0) AS n_joined, e.m * coalesce(s.n, 0) AS joined_n_metadata, CAST(e.n * coalesce(s.lines, 0) AS BIGINT) AS joined_lines
FROM (SELECT trim(kind) AS kind, targetId AS target_id, count(*) AS n, count(metadata) AS m FROM edges WHERE kind IS NOT NULL AND targetId IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM edges)) e
LEFT JOIN (SELECT id, count(*) AS n, sum(coalesce(line, 0)) AS lines FROM (SELECT id, line FROM symbols UNION ALL SELECT id, line FROM shared_symbols) u GROUP BY 1) s ON s.id = e.target_id""",
    "p4_per_target": "SELECT trim(kind) AS kind, targetId AS target_id, count(*) AS n_edges, count(metadata) AS n_metadata, count(DISTINCT sourceId) AS n_sources FROM edges GROUP BY 1, 2",
    "p4_joined": "SELECT trim(e.kind) AS kind, e.targetId AS target_id, count(*) AS n_joined, count(e.metadata) AS joined_n_metadata, CAST(sum(coalesce(s.line, 0)) AS BIGINT) AS joined_lines FROM edges e JOIN (SELECT id, line FROM symbols UNION ALL SELECT id, line FROM shared_symbols) s ON s.id = e.targetId GROUP BY 1, 2",
    "p4_joined_by_kind": "SELECT trim(e.kind) AS kind, count(*) AS n_joined, count(e.metadata) AS joined_n_metadata, CAST(sum(coalesce(s.line, 0)) AS BIGINT) AS joined_lines FROM edges e JOIN (SELECT id, line FROM symbols UNION ALL SELECT id, line FROM shared_symbols) s ON s.id = e.targetId GROUP BY 1",
}
