"""The code graph as it stands: one live row per node, one row per link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import table

LABELS = ["Module", "Class", "Function", "Document", "Configuration", "Directory", "RepositoryMetadata", "Community"]


def label_of(label):
    """A label in its usual spelling."""
    out = F
    for x in LABELS:
        out = out.when(F.lower(F.trim(label)) == x.lower(), x)
    return out.otherwise(F.trim(label))


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The last written row of each id, if it is live: id, label, name, file_path, class_name, type, line_start, repository,
    index_run_id. The last row is found by an aggregate that combines map-side, so a much re-written id costs no sort."""
    p = lambda k: F.col("row.properties")[k].alias(k)
    last = (
        nodes.where(F.col("id").isNotNull()).groupBy("id").agg(
            F.max_by(
                F.struct("label", "properties", "repository", "index_run_id", "deleted_at"),
                F.struct("loaded_at", "index_run_id", "label"),
            ).alias("row")
        )
    )
    return last.where(F.col("row.deleted_at").isNull()).select(
        "id", label_of(F.col("row.label")).alias("label"), p("name"), p("file_path"), p("class_name"), p("type"), p("docstring"),
        F.col("row.properties")["line_start"].cast("int").alias("line_start"), F.col("row.repository").alias("repository"),
        F.col("row.index_run_id").alias("index_run_id"),
    )


def links(edges: DataFrame) -> DataFrame:
    """One row per (src_id, rel, dst_id) with both ends named."""
    return edges.select("src_id", "rel", "dst_id").where((F.col("src_id") != "") & (F.col("dst_id") != "")).distinct()


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return current_nodes(table(spark, folder, "nodes")), links(table(spark, folder, "edges"))


_CANON = "CASE " + " ".join(f"WHEN lower(trim(label)) = '{x.lower()}' THEN '{x}'" for x in LABELS) + " ELSE trim(label) END"

#: The same views in SQL, to put before a query.
VIEWS = f"""
n AS (SELECT id, {_CANON} AS label, properties['name'] AS name, properties['file_path'] AS file_path,
        properties['class_name'] AS class_name, properties['type'] AS type, properties['docstring'] AS docstring,
        TRY_CAST(properties['line_start'] AS INT) AS line_start, repository, index_run_id
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, index_run_id DESC, label DESC) AS rn
            FROM nodes WHERE id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
e AS (SELECT DISTINCT src_id, rel, dst_id FROM edges WHERE src_id <> '' AND dst_id <> '')
"""
