"""Graph queries: node search, neighbours, bounded reachability, composed plans. Every top-k has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.durable import Workspace


def find_nodes(nodes: DataFrame, name: str, label: str | None = None, repository: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name contains ``name``: exact names first, then short ids; with their position. An empty name finds nothing."""
    found = nodes.where(F.col("name").contains(name)) if name else nodes.limit(0)
    if label:
        found = found.where(F.col("label") == label)
    if repository:
        found = found.where(F.col("repository") == repository)
    order = [(F.col("name") != name).cast("int"), F.length("id"), F.col("id")]
    top = found.orderBy(*order).limit(limit)  # TakeOrdered: no full sort
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "id", "name", "label")


def neighbours(links: DataFrame, direction: str = "out", rel: str | None = None) -> DataFrame:
    """(id, rel, other, direction) of every link, seen from its start ('out'), its end ('in') or 'both'."""
    chosen = links.where(F.col("rel") == rel) if rel else links
    out = chosen.select(F.col("src_id").alias("id"), "rel", F.col("dst_id").alias("other"), F.lit("out").alias("direction"))
    into = chosen.select(F.col("dst_id").alias("id"), "rel", F.col("src_id").alias("other"), F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def first_neighbours(seen: DataFrame, limit: int = 30, salts: int = 16) -> DataFrame:
    """At most ``limit`` neighbours of each id, by relation and id. A hot id is ranked in ``salts`` parts first."""
    order = [F.col("rel"), F.col("other"), F.col("direction")]
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("other", "rel"), F.lit(salts)))
    part = salted.withColumn("n", F.row_number().over(Window.partitionBy("id", "salt").orderBy(*order))).where(F.col("n") <= limit)
    whole = part.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("pos") <= limit)
    return whole.drop("salt", "n")


def reachable(links: DataFrame, seeds: DataFrame, rel: str, hops: int, direction: str = "out") -> DataFrame:
    """(seed, id, hop): ids within ``hops`` links of ``rel`` of each seed, with the least number of hops; never the seed itself.

    The frontier is made distinct and kept to new ids after each hop, so that paths do not multiply; each hop is one join on
    the links, written to the shared folder.
    """
    step = neighbours(links, direction, rel).select(F.col("id").alias("from_id"), "other").distinct()
    space = Workspace(links.sparkSession, "reachable")
    step = space.cut(step, "links")
    frontier = seeds.select(F.col("id").alias("seed"), F.col("id")).distinct()
    known = None
    for hop in range(1, hops + 1):
        nxt = frontier.join(step, frontier["id"] == step["from_id"]).select("seed", F.col("other").alias("id")).distinct()
        nxt = nxt.where(F.col("seed") != F.col("id"))
        if known is not None:
            nxt = nxt.join(known, ["seed", "id"], "left_anti")
        nxt = space.cut(nxt.withColumn("hop", F.lit(hop)), f"hop-{hop}")
        known = nxt if known is None else known.unionByName(nxt)
        frontier = nxt.select("seed", "id")
    return known


def dangling(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with an end that no node has: src_id, rel, dst_id."""
    ids = nodes.select("id")
    whole = links.join(ids, links["src_id"] == ids["id"], "left_semi")
    whole = whole.join(ids, whole["dst_id"] == ids["id"], "left_semi")
    return links.join(whole, ["src_id", "rel", "dst_id"], "left_anti")


def labelled(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the labels of both ends; a missing label is inferred from the relation."""
    a = nodes.select(F.col("id").alias("a_id"), F.col("label").alias("src_label"))
    b = nodes.select(F.col("id").alias("b_id"), F.col("label").alias("dst_label"))
    guess = lambda of: F.when(F.col("rel") == "INHERITS", "Class").when(F.col("rel") == "IMPORTS", "Module").when(F.col("rel") == "CALLS", "Function").otherwise(of)
    out = links.join(a, F.col("src_id") == F.col("a_id"), "left").join(b, F.col("dst_id") == F.col("b_id"), "left")
    return out.select(
        "src_id", F.coalesce("src_label", guess(F.lit("Module"))).alias("src_label"), "rel", "dst_id",
        F.coalesce("dst_label", guess(F.lit("Function"))).alias("dst_label"),
    )


def compose(links: DataFrame, anchors: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Follows ``steps`` of (relation, direction) from the anchors: step_0 ... step_k, as a bag of paths."""
    path = anchors.select(F.col("id").alias("step_0"))
    for k, (rel, direction) in enumerate(steps, 1):
        hop = neighbours(links, direction, rel).select(F.col("id").alias("_from"), F.col("other").alias(f"step_{k}"))
        path = path.join(hop, F.col(f"step_{k - 1}") == F.col("_from")).drop("_from")
    return path


def overrides(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Methods that a class defines again: class_id, base_id, method (its name)."""
    method = lambda who, c: (
        links.where(F.col("rel") == "DEFINES")
        .join(nodes.where("label = 'Function'").select("id", "name"), F.col("dst_id") == F.col("id"))
        .select(F.col("src_id").alias(who), F.col("name").alias(c))
    )
    inherits = links.where(F.col("rel") == "INHERITS").select(F.col("src_id").alias("class_id"), F.col("dst_id").alias("base_id"))
    own = inherits.join(method("owner", "method"), F.col("class_id") == F.col("owner")).drop("owner")
    base = method("b", "m").distinct()
    return own.join(base, (F.col("base_id") == F.col("b")) & (F.col("method") == F.col("m")), "left_semi").distinct()


def called_siblings(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each function the other functions of its file that it calls: id, siblings (sorted names), n."""
    f = nodes.where("label = 'Function'").select("id", "file_path", "name").where(F.col("file_path") != "")
    s = f.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_path"), F.col("name").alias("s_name"))
    calls = links.where(F.col("rel") == "CALLS")
    joined = calls.join(f, F.col("src_id") == F.col("id")).join(s, (F.col("dst_id") == F.col("s_id")) & (F.col("file_path") == F.col("s_path")))
    names = joined.select("id", F.col("s_name").alias("name")).distinct()
    return names.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("siblings"), F.count("*").alias("n"))


def degree(links: DataFrame, by: Column) -> DataFrame:
    return links.groupBy(by.alias("id"), "rel").agg(F.count("*").alias("n"))
