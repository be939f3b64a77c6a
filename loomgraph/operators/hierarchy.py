"""Parent-child links to full hierarchies by tree contraction (problem 4).

Links form a forest of unknown depth, possibly with cycles. Each round contracts it in two ways:

* *rake*: every node without children is removed and recorded with its parent;
* *compress*: in chains of nodes with a single child, every node whose hash exceeds the hashes of its parent and its child is
  spliced out and recorded; its child hangs from its parent with the distances (and passed nodes) added up. No two neighbours
  can both be spliced, so a third of each chain goes in a round.

A forest of n nodes is gone after O(log n) rounds, whatever its depth. On a cycle the compression ends in self-loops, which
neither step can remove: that core exposes the cycles. The recorded contractions are then replayed backwards; in each step
the parents of the expanded nodes are already resolved.

All joins of the contraction are on the child's own id, which is unique, so a parent with a third of all children meets no
join key; counting its children is combined map-side. In the expansion the parent's side has one row per id, and adaptive
execution splits a hot parent's children. Each round is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.durable import Workspace


def parent_links(edges: DataFrame) -> DataFrame:
    """(child, parent) of DEFINES (src is the parent) and WEAK_LINK (dst is the parent), both ends neither null nor empty."""
    down = F.col("rel") == "DEFINES"
    return (
        edges.where(F.col("rel").isin("DEFINES", "WEAK_LINK"))
        .select(
            F.when(down, F.col("dst_id")).otherwise(F.col("src_id")).alias("child"),
            F.when(down, F.col("src_id")).otherwise(F.col("dst_id")).alias("parent"),
        )
        .where((F.col("child") != "") & (F.col("parent") != ""))
    )


def _round(tree: DataFrame, number: int, with_path: bool, with_size: bool) -> DataFrame:
    """One rake and one compress over (node, parent, dist[, via][, w, e]); adds below, e_below and state: 'raked', 'spliced', 'alive'.

    ``w`` counts the node and what was raked into it, ``e`` what was spliced out between it and its parent.
    """
    children = tree.groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n_children"), F.min("node").alias("only_child"), *([F.min("e").alias("e_child")] if with_size else [])
    )
    known = tree.join(children, tree["node"] == children["id"], "left").drop("id")
    rank = lambda c: F.xxhash64(F.col(c), F.lit(number))
    peak = (F.col("n_children") == 1) & (rank("node") > rank("parent")) & (rank("node") > rank("only_child"))
    known = known.withColumn("spliced", F.coalesce(peak, F.lit(False)))
    over = known.where("spliced").select(
        F.col("only_child").alias("below_node"),
        F.col("parent").alias("up_parent"),
        F.col("dist").alias("up_dist"),
        *([F.concat("via", F.array("node")).alias("up_via")] if with_path else []),
        *([(F.col("w") + F.col("e")).alias("up_e")] if with_size else []),
    )
    moved = known.join(over, known["node"] == over["below_node"], "left")
    leaf = F.col("n_children").isNull()
    # a leaf below a spliced node moves too: it is recorded with its new parent
    out = moved.select(
        "node",
        F.coalesce("up_parent", "parent").alias("parent"),
        (F.col("dist") + F.coalesce("up_dist", F.lit(0))).alias("dist"),
        *([F.when(F.col("up_via").isNull(), F.col("via")).otherwise(F.concat("up_via", "via")).alias("via")] if with_path else []),
        *([F.col("w"), (F.col("e") + F.coalesce("up_e", F.lit(0))).alias("e"), F.col("only_child").alias("below"), F.col("e_child").alias("e_below")] if with_size else []),
        F.when(leaf, "raked").when(F.col("spliced"), "spliced").otherwise("alive").alias("state"),
    )
    if not with_size:
        return out
    # what is raked counts for its new parent, which is alive or a root
    raked = moved.where(leaf).select(
        F.coalesce("up_parent", "parent").alias("into"), (F.col("w") + F.col("e") + F.coalesce("up_e", F.lit(0))).alias("more")
    ).groupBy("into").agg(F.sum("more").alias("more"))
    grown = out.join(raked, (F.col("node") == F.col("into")) & (F.col("state") == "alive"), "left")
    return grown.withColumn("w", F.col("w") + F.coalesce("more", F.lit(0))).drop("into", "more")


def resolve_hierarchy(
    links: DataFrame, with_path: bool = False, max_rounds: int = 400, with_size: bool = False, weights: DataFrame | None = None
) -> DataFrame:
    """Root and depth of every id in ``links`` (child, parent): node_id, root_id, depth[, path][, size].

    ``path`` is the array of ids from the root to the node, ``size`` the number of ids at and below it (0 on or below a cycle).
    Roots have depth 0. Ids on or below a cycle (a self-link is one) have root_id '', depth -1 and an empty path. With ``weights``
    (node, weight) depth adds up the weights of the links instead of counting them. Repeated links count once; null or empty ends
    are no links; of several parents the smallest id counts. An empty input gives an empty result; other columns are ignored.
    """
    links = links.select("child", "parent").where((F.col("child") != "") & (F.col("parent") != ""))
    space = Workspace(links.sparkSession, "hierarchy")
    tree = links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent")).withColumn("dist", F.lit(1).cast("bigint"))
    if weights is not None:
        w = weights.select(F.col("node").alias("w_node"), F.col("weight").cast("bigint").alias("w_weight"))
        tree = tree.join(w, F.col("node") == F.col("w_node"), "left").select("node", "parent", F.coalesce("w_weight", "dist").alias("dist"))
    if with_path:
        tree = tree.withColumn("via", F.array().cast("array<string>"))
    if with_size:
        tree = tree.withColumn("w", F.lit(1).cast("bigint")).withColumn("e", F.lit(0).cast("bigint"))
    first = tree = space.cut(tree, "links")

    records: list[DataFrame] = []
    for number in range(max_rounds):
        done = space.cut(_round(tree, number, with_path, with_size), f"round-{number}")
        sizes = {r["state"]: r["count"] for r in done.groupBy("state").count().collect()}
        tree = done.where("state = 'alive'").drop("state", "below", "e_below")
        if sizes.keys() - {"alive"}:
            records.append(done.where("state <> 'alive'"))
        if not sizes.get("alive") or set(sizes) == {"alive"}:
            break
    else:
        raise RuntimeError(f"{max_rounds} rounds did not contract the links")

    columns = ["node_id", "root_id", "depth", *(["path"] if with_path else []), *(["size"] if with_size else [])]
    nowhere, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    cyclic = tree.select(
        F.col("node").alias("node_id"), F.lit("").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"),
        *([nowhere.alias("path")] if with_path else []), *([zero.alias("size")] if with_size else []),
    )
    roots = (
        links.select(F.col("parent").alias("node_id")).distinct()
        .join(first.select(F.col("node").alias("node_id")), "node_id", "left_anti")
        .select(
            "node_id", F.col("node_id").alias("root_id"), zero.alias("depth"),
            *([F.array("node_id").alias("path")] if with_path else []), *([zero.alias("size")] if with_size else []),
        )
    )
    known = space.cut(roots.unionByName(cyclic), "resolved/step=0")
    paths = [space.path("resolved/step=0")]
    for step, record in enumerate(reversed(records), 1):
        up = known.select(*(F.col(c).alias(f"up_{c}") for c in columns))
        lost = F.col("up_depth") < 0
        found = record.join(up, F.col("parent") == F.col("up_node_id"))
        if with_size:
            # of a spliced node: itself, what was raked into it, what lay between it and its child, and the child with all below
            held = known.select("node_id", "size").unionByName(record.where("state = 'raked'").select(F.col("node").alias("node_id"), F.col("w").alias("size")))
            held = held.select(F.col("node_id").alias("h_node"), F.col("size").alias("h_size"))
            found = found.join(held, (F.col("below") == F.col("h_node")) & (F.col("state") == "spliced"), "left")
            whole = F.col("w") + F.when(F.col("state") == "spliced", F.col("e_below") + F.col("h_size")).otherwise(0)
        found = found.select(
            F.col("node").alias("node_id"),
            F.col("up_root_id").alias("root_id"),
            F.when(lost, F.lit(-1).cast("bigint")).otherwise(F.col("up_depth") + F.col("dist")).alias("depth"),
            *([F.when(lost, nowhere).otherwise(F.concat("up_path", "via", F.array("node"))).alias("path")] if with_path else []),
            *([F.when(lost, zero).otherwise(whole).alias("size")] if with_size else []),
        )
        space.cut(found, f"resolved/step={step}")
        paths.append(space.path(f"resolved/step={step}"))
        known = links.sparkSession.read.schema(known.schema).parquet(*paths)
    for done in ["links", *(f"round-{i}" for i in range(number + 1))]:  # all that is read from here on is under resolved
        space.drop(done)
    if with_size:
        below = known.where("depth >= 0").groupBy(F.col("root_id").alias("r_id")).agg(F.count("*").alias("r_size"))
        known = known.join(below, (F.col("node_id") == F.col("r_id")) & (F.col("depth") == 0), "left").withColumn("size", F.coalesce("r_size", "size")).drop("r_id", "r_size")
    return known.withColumn("depth", F.col("depth").cast("int")) if weights is None else known


def _running(rows: DataFrame, group: str, order: str, value: str, partitions: int) -> DataFrame:
    """Adds before: the sum of ``value`` over the earlier rows (by ``order``) of the same ``group``, however large one is.

    Rows are sorted over all partitions by range; sums run within partitions, and the few sums of whole partitions are put on top.
    """
    ranged = rows.repartitionByRange(partitions, group, order).withColumn("_part", F.spark_partition_id())
    ranged = Workspace(rows.sparkSession, "running").cut(ranged, "ranged")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(group, order))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row per partition
    base = totals.withColumn("_base", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).select(F.col("_part").alias("_p"), "_base")
    upto = ranged.withColumn("_inside", inside).join(F.broadcast(base), F.col("_part") == F.col("_p")).withColumn("_upto", F.col("_inside") + F.col("_base") - F.col(value))
    start = upto.groupBy(F.col(group).alias("_g")).agg(F.min("_upto").alias("_start"))
    return upto.join(start, F.col(group) == F.col("_g")).withColumn("before", F.col("_upto") - F.col("_start")).select(*rows.columns, "before")


def preorder(links: DataFrame) -> DataFrame:
    """Every id that is neither on nor below a cycle with its place in a walk of its tree, children by id: node_id, root_id, depth,
    first, last. The descendants of a node are the ids of its root with ``first`` in (first, last] of the node.

    Sizes come from a first contraction; they give each child its distance from its parent in the walk, and a second contraction
    adds these distances up. No path is held and no pair is made.
    """
    links = links.select("child", "parent").where((F.col("child") != "") & (F.col("parent") != ""))
    once = links.groupBy("child").agg(F.min("parent").alias("parent"))
    space = Workspace(links.sparkSession, "preorder")
    known = space.cut(resolve_hierarchy(links, with_size=True).where("depth >= 0"), "sizes")
    children = once.join(known.select(F.col("node_id").alias("child"), "size"), "child")
    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = _running(children, "parent", "child", "size", partitions).select(F.col("child").alias("node"), (F.col("before") + 1).alias("weight"))
    places = resolve_hierarchy(links, weights=space.cut(steps, "steps")).where("depth >= 0").select(F.col("node_id").alias("p_id"), F.col("depth").alias("first"))
    out = known.join(places, F.col("node_id") == F.col("p_id"))
    return out.select("node_id", "root_id", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor_id, node_id, distance) with distance >= 1, from a result with ``path``; ids in cycles have none.

    For those who want the pairs themselves: they are as many as the depths add up to. ``preorder`` gives descendants as ranges.
    Each pair comes from its own node's path, so no group is gathered.
    """
    return (
        resolved.where("depth > 0")
        .select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
        .where(F.col("pos") < F.col("depth"))
        .select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    )
