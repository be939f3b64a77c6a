"""Keyed upserts, removal of stale runs and differences between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union of both by ``keys``; where both have a row, values of ``new`` go over those of ``old`` unless null, and maps
    key by key."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    types = dict(old.dtypes)

    def put(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if not types[c].startswith("map<"):
            return F.coalesce(now, was)
        kept = F.map_filter(was, lambda k, _: ~F.array_contains(F.map_keys(now), k))
        return F.when(was.isNull(), now).when(now.isNull(), was).otherwise(F.map_concat(kept, now))

    return o.join(n, on, "full").select(*(put(c).alias(c) for c in old.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so repeats are dropped before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def _detached(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``gone`` (id) and without the links at either end of them."""
    gone = gone.select(F.col("id").alias("gone"))
    kept = links.join(gone, F.col("src_id") == F.col("gone"), "left_anti").join(gone, F.col("dst_id") == F.col("gone"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), kept


def last_runs(nodes: DataFrame) -> DataFrame:
    """(repository, run): the run that wrote last to each repository."""
    known = nodes.where("repository IS NOT NULL AND index_run_id IS NOT NULL")
    return known.groupBy("repository").agg(F.max_by("index_run_id", F.struct("loaded_at", "index_run_id")).alias("run"))


def without_stale(nodes: DataFrame, links: DataFrame, runs: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes that another run wrote than the one ``runs`` (repository, run) has for their repository,
    and without the links at either end of them. With ``files`` (repository, file_path) only nodes of those files go."""
    r = runs.select(F.col("repository").alias("r_repository"), "run")
    stale = nodes.join(r, (F.col("repository") == F.col("r_repository")) & (F.coalesce("index_run_id", F.lit("")) != F.col("run")), "left_semi")
    return _detached(nodes, links, stale if files is None else _of_files(stale, files))


def _of_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select(F.col("repository").alias("f_repository"), F.col("file_path").alias("f_path"))
    return nodes.join(f, (F.col("repository") == F.col("f_repository")) & (F.col("file_path") == F.col("f_path")), "left_semi")


def without_files(nodes: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``files`` (repository, file_path) and their links."""
    return _detached(nodes, links, _of_files(nodes, files))


def without_repositories(nodes: DataFrame, links: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``repositories`` (repository) and their links."""
    r = repositories.select(F.col("repository").alias("r_repository"))
    return _detached(nodes, links, nodes.join(r, F.col("repository") == F.col("r_repository"), "left_semi"))


def stamped(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``meta`` (one row per repository); last_indexed_commit goes by the name indexed_commit."""
    m = meta.withColumnsRenamed({"repository": "m_repository", "last_indexed_commit": "indexed_commit"})
    return rows.join(m, F.col("repository") == F.col("m_repository"), "left").drop("m_repository")


def run_changes(nodes: DataFrame) -> DataFrame:
    """Between consecutive runs of a repository (numbered after '-r'): repository, run, added, removed, kept ids."""
    number = F.regexp_extract("index_run_id", r"-r(\d+)$", 1)
    runs = nodes.where(F.col("repository").isNotNull() & (number != "")).select("repository", number.cast("int").alias("run"), "id").distinct()
    was = runs.select("repository", (F.col("run") + 1).alias("run"), "id").withColumn("was", F.lit(True))
    both = runs.withColumn("is", F.lit(True)).join(was, ["repository", "run", "id"], "full")
    last = runs.groupBy("repository").agg(F.max("run").alias("last"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has, had = F.col("is").isNotNull(), F.col("was").isNotNull()
    out = both.join(last, "repository").where(F.col("run") <= F.col("last")).groupBy("repository", "run")
    return out.agg(n(has & ~had).alias("added"), n(~has & had).alias("removed"), n(has & had).alias("kept"))


def upsert_links(nodes: DataFrame, old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Links of both tables by (src_id, rel, dst_id); new ones only if both ends are nodes, of repeated ones the last by
    ``order``; their other columns go over the old, maps key by key."""
    ids = nodes.select("id")
    sound = new.join(ids, new["src_id"] == ids["id"], "left_semi")
    sound = sound.join(ids, sound["dst_id"] == ids["id"], "left_semi")
    keys = ["src_id", "rel", "dst_id"]
    return overlay(old, last_wins(sound, keys, order), keys)


def written_as_text(rows: DataFrame) -> DataFrame:
    """``rows`` as a store takes them: no nulls, arrays and structs as JSON, other values that are no text as text."""

    def text(c: str, kind: str) -> Column:
        value = F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return rows.select(*(text(c, kind) for c, kind in rows.dtypes))


def write_by_repository(df: DataFrame, path: str) -> None:
    """Replaces only the repositories that ``df`` has; reads of one repository prune the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(path)
