"""References to records that do not exist (problem 1).

Every edge names two nodes. A reference is *orphaned* when, at the time the edge was loaded, no row of the named node was
live. The plan rests on one aggregate and splits references by how often their key is named:

* references are pre-aggregated per key and month (map-side combined): how many, the first and the last time. Compared with the
  intervals in which the key was live, nearly every such group is decided as a whole: always live, missing, late or deleted.
  The few that are not are *mixed*;
* groups that are always live are dropped. If those left are at most ``max_broadcast_rows`` they are broadcast and references
  do not travel at all. Otherwise only the heavy ones are (those that would fill a quarter of a shuffle partition, which bounds
  their number), and the references of all others are shuffled on key and month;
* mixed groups go through an anti-join with the live intervals, broadcast behind the same check, or salted where a key is heavy;
* both results are united: rows for ``orphan_references``, counts for ``orphan_report``, which takes the counts of decided groups
  from the aggregate and joins no single reference to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.durable import Workspace

FOREVER = "9999-12-31 00:00:00"
NEVER = "0001-01-01 00:00:00"


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def references(edges: DataFrame) -> DataFrame:
    """One row per edge and endpoint whose id is neither null nor empty: edge_id, endpoint, ref, rel, repository, period, at.

    ``period`` is the first day of the month of ``observed_at`` (null if that is null). An edge without ``loaded_at``
    counts as loaded at the end of time.
    """
    ends = F.array(
        F.struct(F.lit("src").alias("endpoint"), F.col("src_id").alias("ref")),
        F.struct(F.lit("dst").alias("endpoint"), F.col("dst_id").alias("ref")),
    )
    return (
        edges.select(
            "edge_id",
            F.inline(ends),
            "rel",
            "repository",
            F.trunc("observed_at", "month").alias("period"),
            F.coalesce(F.col("loaded_at").cast("timestamp"), _ts(FOREVER)).alias("at"),
        ).where(F.col("ref").isNotNull() & (F.col("ref") != ""))
    )


def live_intervals(nodes: DataFrame) -> DataFrame:
    """Half-open validity intervals (ref, since, until), overlapping ones merged within each month of ``since``.

    Merging by key *and* month keeps one re-written key from filling a single task and leaves few intervals per key.
    A row without ``loaded_at`` counts as live from the start; one deleted before it was loaded was never live.
    """
    rows = (
        nodes.select(
            F.col("id").alias("ref"),
            F.coalesce(F.col("loaded_at").cast("timestamp"), _ts(NEVER)).alias("since"),
            F.coalesce(F.col("deleted_at").cast("timestamp"), _ts(FOREVER)).alias("until"),
        )
        .where(F.col("ref").isNotNull() & (F.col("since") < F.col("until")))
        .groupBy("ref", "since")
        .agg(F.max("until").alias("until"))
        .withColumn("slot", F.trunc("since", "month"))
    )
    by_slot = Window.partitionBy("ref", "slot").orderBy("since")
    before = F.max("until").over(by_slot.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("since") > before), 1).otherwise(0)
    return (
        rows.withColumn("starts", starts)
        .withColumn("island", F.sum("starts").over(by_slot))
        .groupBy("ref", "slot", "island")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"))
        .select("ref", "since", "until")
    )


def per_key_and_period(refs: DataFrame, *also: str) -> DataFrame:
    """References per key and month (and ``also``): ref, period, ..., n, first, last."""
    return refs.groupBy("ref", "period", *also).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def decided(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref, period, n, status of each group of ``per_key_and_period``: 'live', 'missing', 'late', 'deleted', or 'mixed' where its
    references may differ."""
    g = groups.groupBy("ref", "period").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    facts = nodes.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("known")).agg(
        F.max(F.coalesce(F.col("loaded_at").cast("timestamp"), _ts(NEVER))).alias("last_loaded")
    )
    live = live_intervals(nodes).withColumnRenamed("ref", "v_ref")
    met = g.join(live, F.col("ref") == F.col("v_ref"), "left").groupBy("ref", "period").agg(
        F.first("n").alias("n"), F.first("first").alias("first"), F.first("last").alias("last"),
        F.max(F.coalesce((F.col("since") <= F.col("first")) & (F.col("until") > F.col("last")), F.lit(False))).alias("covered"),
        F.max(F.coalesce((F.col("since") <= F.col("last")) & (F.col("until") > F.col("first")), F.lit(False))).alias("touched"),
    )
    status = (
        F.when(F.col("known").isNull(), "missing").when(F.col("covered"), "live").when(F.col("touched"), "mixed")
        .when(F.col("last_loaded") > F.col("last"), "late").when(F.col("last_loaded") <= F.col("first"), "deleted").otherwise("mixed")
    )
    return met.join(facts, F.col("ref") == F.col("known"), "left").select("ref", "period", "n", status.alias("status"))


def _same_group(refs: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    g = groups.select(F.col("ref").alias("g_ref"), F.col("period").alias("g_period"), *(c for c in groups.columns if c not in ("ref", "period", "n")))
    out = refs.join(g, (F.col("ref") == F.col("g_ref")) & F.col("period").eqNullSafe(F.col("g_period")), how)
    return out.drop("g_ref", "g_period")


def _at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def heavy_groups(groups: DataFrame, partitions: int) -> DataFrame:
    """Groups that hold a quarter of a shuffle partition or more: at most four times as many as there are partitions."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return groups.where(F.col("n") >= max(1.0, total / (4 * partitions)))


def with_status(refs: DataFrame, groups: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """References of the groups that are not always live, with the group's status."""
    lost = groups.where("status <> 'live'")
    if _at_most(lost, max_broadcast_rows):
        return _same_group(refs, F.broadcast(lost))
    heavy = heavy_groups(groups, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("ref", "period", "status")
    hot = _same_group(refs, F.broadcast(heavy.where("status <> 'live'")))
    others = _same_group(refs, F.broadcast(heavy.select("ref", "period")), "left_anti")
    return hot.unionByName(_same_group(others, _same_group(lost, F.broadcast(heavy.select("ref", "period")), "left_anti")))


def _without_live(refs: DataFrame, live: DataFrame, *also: str) -> DataFrame:
    """References for which no live interval holds at their time."""
    r, v = refs.alias("r"), live.alias("v")
    on = (F.col("r.ref") == F.col("v.ref")) & (F.col("v.since") <= F.col("r.at")) & (F.col("v.until") > F.col("r.at"))
    for c in also:
        on = on & (F.col(f"r.{c}") == F.col(f"v.{c}"))
    return r.join(v, on, "left_anti")


def mixed_orphans(mixed: DataFrame, keys: DataFrame, nodes: DataFrame, max_broadcast_rows: int, salts: int) -> DataFrame:
    """Orphans among the references of mixed groups, each with its own status. ``keys`` are the groups' keys (ref)."""
    held = nodes.join(keys.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")
    live = live_intervals(held)
    facts = held.groupBy(F.col("id").alias("known")).agg(F.max(F.coalesce(F.col("loaded_at").cast("timestamp"), _ts(NEVER))).alias("last_loaded"))
    if _at_most(live, max_broadcast_rows):
        orphans, facts = _without_live(mixed, F.broadcast(live)), F.broadcast(facts)
    else:
        salted = mixed.withColumn("salt", F.pmod(F.xxhash64("edge_id"), F.lit(salts)).cast("int"))
        copies = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        orphans = _without_live(salted, copies, "salt").drop("salt")
    status = F.when(F.col("last_loaded") > F.col("at"), "late").otherwise("deleted")
    return orphans.join(facts, F.col("ref") == F.col("known")).withColumn("status", status).drop("known", "last_loaded")


def orphan_references(edges: DataFrame, nodes: DataFrame, max_broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Orphaned references: edge_id, endpoint, ref, rel, repository, period, status.

    status is 'missing' (no row of the id at any time), 'late' (some row of it was loaded after the edge) or 'deleted'.
    Ids compare exactly as written. Null and empty ids are no references. Repeated edge rows give equal rows once
    (distinct). Empty inputs give an empty result, or all references as 'missing' where only ``nodes`` is empty. Columns
    beyond the named ones are ignored.
    """
    refs = references(edges)
    groups = Workspace(edges.sparkSession, "orphans").cut(decided(per_key_and_period(refs), nodes), "groups")
    found = with_status(refs, groups, max_broadcast_rows)
    mixed = groups.where("status = 'mixed'")
    apart = mixed_orphans(found.where("status = 'mixed'").drop("status"), mixed, nodes, max_broadcast_rows, salts)
    rows = found.where("status <> 'mixed'").unionByName(apart)
    return rows.select("edge_id", "endpoint", "ref", "rel", "repository", "period", "status").distinct()


def orphan_report(edges: DataFrame, nodes: DataFrame, max_broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """References and orphans per rel, repository and month: rel, repository, period, refs, missing, late, deleted.

    Repeated rows (equal edge_id) count once. Null rel, repository and period form groups of their own.
    """
    columns = ["edge_id", "src_id", "rel", "dst_id", "repository", "observed_at", "loaded_at"]
    refs = references(edges.select(*columns).dropDuplicates(["edge_id"]))
    space = Workspace(edges.sparkSession, "orphan-report")
    counts = space.cut(per_key_and_period(refs, "rel", "repository"), "counts")
    groups = space.cut(decided(counts, nodes), "groups")
    mixed = groups.where("status = 'mixed'")
    rows = refs.where("false")
    if not _at_most(mixed, 0):
        every = references(edges.select(*columns))
        rows = with_status(every, mixed, max_broadcast_rows).drop("status").distinct()
    keys = ["rel", "repository", "period"]
    apart = mixed_orphans(rows, mixed, nodes, max_broadcast_rows, salts).groupBy(*keys, "status").agg(F.count("*").alias("n"))
    whole = with_status(counts, groups.where("status <> 'mixed'"), max_broadcast_rows).groupBy(*keys, "status").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("status", F.lit("refs"))
    one = lambda s: F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(s)
    return (
        totals.unionByName(whole.unionByName(apart))
        .groupBy(*keys)
        .agg(one("refs"), one("missing"), one("late"), one("deleted"))
        .select("rel", "repository", F.col("period").cast("string").alias("period"), "refs", "missing", "late", "deleted")
    )
