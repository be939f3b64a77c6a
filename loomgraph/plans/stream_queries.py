"""Queries that read their tables as streams, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from loomgraph.functions.durable import Workspace
from loomgraph.sources.tables import table
from loomgraph.streaming.ingest import combined, follow, keyed_versions, latest, partial_counts, windowed_counts


def _drain(query) -> None:
    query.awaitTermination()


def _arriving(spark: SparkSession, folder: str, name: str, columns: list[str], space: Workspace) -> tuple[str, StructType]:
    """The table cut into files by its time of loading, so that it arrives in several batches; rows that were observed earlier than
    others come late."""
    rows = table(spark, folder, name, *columns)
    rows.repartitionByRange(6, "loaded_at").write.mode("overwrite").parquet(space.path("source"))
    return space.path("source"), rows.schema


def streamed_relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges per relation and repository, counted batch by batch."""
    space, keys = Workspace(spark, "streamed-counts"), ["rel", "repository"]
    source, schema = _arriving(spark, folder, "edges", ["edge_id", *keys, "loaded_at"], space)
    _drain(follow(spark, source, schema, space.path("state"), partial_counts(space.path("out"), keys), files=1))
    return combined(spark, space.path("out"), keys)


def streamed_last_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The last written run of each node id, kept up batch by batch."""
    space, order = Workspace(spark, "streamed-nodes"), ["loaded_at", "index_run_id", "label"]
    source, schema = _arriving(spark, folder, "nodes", ["id", "label", "repository", "index_run_id", "loaded_at"], space)
    _drain(follow(spark, source, schema, space.path("state"), keyed_versions(space.path("out"), ["id"], order), files=1))
    return latest(spark, space.path("out"), ["id"], order).select("id", "label", "index_run_id")


def streamed_daily_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges per day of observation and relation from a stream with a watermark that waits for the latest rows of these tables."""
    space = Workspace(spark, "streamed-days")
    source, schema = _arriving(spark, folder, "edges", ["edge_id", "rel", "observed_at", "loaded_at"], space)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = windowed_counts(stream.withColumn("observed_at", stream["observed_at"].cast("timestamp")), "observed_at", "rel", late="400 days")
    sink = keyed_versions(space.path("out"), ["since", "rel"], ["n"])  # counts only grow
    _drain(counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", space.path("state")).trigger(availableNow=True).start())
    days = latest(spark, space.path("out"), ["since", "rel"], ["n"])
    return days.selectExpr("cast(to_date(since) AS string) AS day", "rel", "n")


QUERIES = {"streamed_relation_counts": streamed_relation_counts, "streamed_last_nodes": streamed_last_nodes, "streamed_daily_edges": streamed_daily_edges}
SQL = {
    "streamed_relation_counts": "SELECT rel, repository, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1, 2",
    "streamed_last_nodes": """SELECT id, label, index_run_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, index_run_id DESC, label DESC) AS rn
    FROM (SELECT DISTINCT id, label, index_run_id, loaded_at FROM nodes)) WHERE rn = 1""",
    "streamed_daily_edges": "SELECT CAST(CAST(observed_at AS DATE) AS VARCHAR) AS day, rel, CAST(count(*) AS BIGINT) AS n FROM edges WHERE observed_at IS NOT NULL GROUP BY 1, 2",
}
