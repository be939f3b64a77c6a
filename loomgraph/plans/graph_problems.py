"""Queries of problems 1 and 4 over the data folder, with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.hierarchy import descendants, parent_links, preorder, resolve_hierarchy
from loomgraph.operators.references import orphan_references, orphan_report
from loomgraph.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lost = orphan_references(table(spark, folder, "edges"), table(spark, folder, "nodes"))
    return lost.select("edge_id", "endpoint", "status")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(table(spark, folder, "edges"), table(spark, folder, "nodes"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_hierarchy(parent_links(table(spark, folder, "edges", "src_id", "rel", "dst_id")))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    known = resolve_hierarchy(parent_links(table(spark, folder, "edges", "src_id", "rel", "dst_id")), with_path=True)
    return known.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    known = resolve_hierarchy(parent_links(table(spark, folder, "edges", "src_id", "rel", "dst_id")), with_path=True)
    return descendants(known)


def p4_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Descendants as ranges of places in a walk of each tree."""
    return preorder(parent_links(table(spark, folder, "edges", "src_id", "rel", "dst_id")))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
    "p4_ranges": p4_ranges,
}

_ORPHANS = """
WITH e AS (SELECT DISTINCT edge_id, src_id, dst_id, rel, repository, observed_at, loaded_at FROM edges),
refs AS (
  SELECT edge_id, 'src' AS endpoint, src_id AS ref, rel, repository, date_trunc('month', observed_at) AS period, loaded_at FROM e
  UNION ALL
  SELECT edge_id, 'dst', dst_id, rel, repository, date_trunc('month', observed_at), loaded_at FROM e),
named AS (SELECT * FROM refs WHERE ref IS NOT NULL AND ref <> ''),
last AS (SELECT id, max(loaded_at) AS last_loaded FROM nodes WHERE id IS NOT NULL GROUP BY id),
orphans AS (
  SELECT r.edge_id, r.endpoint, r.rel, r.repository, r.period,
         CASE WHEN l.id IS NULL THEN 'missing' WHEN l.last_loaded > r.loaded_at THEN 'late' ELSE 'deleted' END AS status
  FROM named r LEFT JOIN last l ON l.id = r.ref
  WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = r.ref AND n.loaded_at <= r.loaded_at
                    AND (n.deleted_at IS NULL OR n.deleted_at > r.loaded_at)))
"""

_TREE = """
WITH RECURSIVE links AS (
  SELECT DISTINCT CASE WHEN rel = 'DEFINES' THEN dst_id ELSE src_id END AS child,
                  CASE WHEN rel = 'DEFINES' THEN src_id ELSE dst_id END AS parent
  FROM edges WHERE rel IN ('DEFINES', 'WEAK_LINK') AND src_id <> '' AND dst_id <> ''),
ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
walk AS (
  SELECT id AS node_id, id AS root_id, 0 AS depth, id AS path FROM ids WHERE id NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, w.root_id, w.depth + 1, w.path || ' > ' || l.child FROM walk w JOIN links l ON l.parent = w.node_id),
every AS (
  SELECT node_id, root_id, depth, path FROM walk
  UNION ALL SELECT id, '', -1, '' FROM ids WHERE id NOT IN (SELECT node_id FROM walk))
"""

SQL = {
    "p1_found": _ORPHANS + "SELECT edge_id, endpoint, status FROM orphans",
    "p1_report": _ORPHANS
    + """SELECT rel, repository, CAST(CAST(period AS DATE) AS VARCHAR) AS period, CAST(sum(refs) AS BIGINT) AS refs,
         CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(late) AS BIGINT) AS late, CAST(sum(deleted) AS BIGINT) AS deleted
         FROM (SELECT rel, repository, period, 1 AS refs, 0 AS missing, 0 AS late, 0 AS deleted FROM named
               UNION ALL SELECT rel, repository, period, 0, CAST(status = 'missing' AS INT), CAST(status = 'late' AS INT),
                                CAST(status = 'deleted' AS INT) FROM orphans) GROUP BY ALL""",
    "p4_found": _TREE + "SELECT node_id, root_id, depth FROM every",
    "p4_paths": _TREE + "SELECT node_id, root_id, depth, path FROM every",
    "p4_descendants": _TREE
    + """, up AS (
      SELECT child AS node_id, parent AS ancestor_id, 1 AS distance FROM links WHERE child IN (SELECT node_id FROM walk)
      UNION ALL SELECT u.node_id, l.parent, u.distance + 1 FROM up u JOIN links l ON l.child = u.ancestor_id)
      SELECT ancestor_id, node_id, distance FROM up""",
    "p4_ranges": _TREE
    + """, up AS (
      SELECT child AS node_id, child AS ancestor_id FROM links WHERE child IN (SELECT node_id FROM walk)
      UNION ALL SELECT u.node_id, l.parent FROM up u JOIN links l ON l.child = u.ancestor_id),
      size AS (SELECT ancestor_id AS id, count(*) AS size FROM up GROUP BY 1),
      own AS (SELECT w.node_id AS id, CASE WHEN w.depth = 0 THEN coalesce(s.size, 0) + 1 ELSE s.size END AS size, l.parent
              FROM walk w LEFT JOIN size s ON s.id = w.node_id LEFT JOIN links l ON l.child = w.node_id),
      step AS (SELECT id, 1 + coalesce(sum(size) OVER (PARTITION BY parent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step
               FROM own WHERE parent IS NOT NULL),
      place AS (SELECT u.node_id AS id, sum(step) AS first FROM up u JOIN step ON step.id = u.ancestor_id GROUP BY 1)
      SELECT w.node_id, w.root_id, w.depth, CAST(coalesce(p.first, 0) AS BIGINT) AS first, CAST(coalesce(p.first, 0) + o.size - 1 AS BIGINT) AS last
      FROM walk w JOIN own o ON o.id = w.node_id LEFT JOIN place p ON p.id = w.node_id""",
}
