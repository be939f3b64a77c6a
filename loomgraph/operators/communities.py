"""Folders as communities of the graph: members, inner and crossing links, weighted dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import dirname


def members(nodes: DataFrame) -> DataFrame:
    """(id, community): the repository and folder of every node of a repository."""
    kept = nodes.where(F.col("repository").isNotNull() & F.col("label").isin("Module", "Class", "Function"))
    return kept.select("id", F.concat_ws("::", "repository", dirname(F.col("file_path"))).alias("community"))


def communities(nodes: DataFrame) -> DataFrame:
    """community, size; folders of a single member are communities too."""
    return members(nodes).groupBy("community").agg(F.count("*").alias("size"))


def crossing(links: DataFrame, member: DataFrame) -> DataFrame:
    """Links between members with the communities of both ends: src_id, dst_id, src_community, dst_community."""
    a = member.select(F.col("id").alias("a_id"), F.col("community").alias("src_community"))
    b = member.select(F.col("id").alias("b_id"), F.col("community").alias("dst_community"))
    return links.join(a, F.col("src_id") == F.col("a_id")).join(b, F.col("dst_id") == F.col("b_id")).select(
        "src_id", "dst_id", "src_community", "dst_community"
    )


def link_counts(links: DataFrame, member: DataFrame) -> DataFrame:
    """Undirected simple links inside each community and across its border: community, inner, border."""
    pairs = crossing(links, member).where("src_id <> dst_id").select(
        F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b"),
        F.when(F.col("src_id") < F.col("dst_id"), F.col("src_community")).otherwise(F.col("dst_community")).alias("ca"),
        F.when(F.col("src_id") < F.col("dst_id"), F.col("dst_community")).otherwise(F.col("src_community")).alias("cb"),
    ).distinct()
    seen = pairs.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("inner"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return seen.groupBy("community").agg(n(F.col("inner")).alias("inner"), n(~F.col("inner")).alias("border"))


def dependencies(links: DataFrame, member: DataFrame) -> DataFrame:
    """Directed links between different communities: src_community, dst_community, weight."""
    return crossing(links, member).where("src_community <> dst_community").groupBy("src_community", "dst_community").agg(F.count("*").alias("weight"))


def community_links(links: DataFrame, member: DataFrame) -> DataFrame:
    """What communities add to a graph: src_id, rel, dst_id, weight. IN_COMMUNITY from each member to its community, DEPENDS_ON
    between communities. Written by repository (``upserts.write_by_repository``), they replace those of earlier runs."""
    inside = member.select(F.col("id").alias("src_id"), F.lit("IN_COMMUNITY").alias("rel"), F.col("community").alias("dst_id"), F.lit(1).cast("bigint").alias("weight"))
    between = dependencies(links, member).select(F.col("src_community").alias("src_id"), F.lit("DEPENDS_ON").alias("rel"), F.col("dst_community").alias("dst_id"), "weight")
    return inside.unionByName(between)
