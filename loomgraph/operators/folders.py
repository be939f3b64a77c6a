"""Folders of files: every ancestor once, and the links from files and folders to what holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_links(files: DataFrame) -> DataFrame:
    """(src_id, rel, dst_id, repository): WEAK_LINK from each folder to its parent, or to the repository at the top."""
    path = F.regexp_replace(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.size("parts") - 1
    folders = (
        files.where(F.col("file_path").isNotNull()).select("repository", parts.alias("parts")).where(depth > 0)
        .select("repository", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.slice("parts", 1, n))).alias("f"))
        .distinct()
    )
    name = lambda f: F.concat(F.col("repository"), F.lit("::dir::"), F.array_join(f, "/"))
    up = F.when(F.size("f") > 1, name(F.slice("f", 1, F.size("f") - 1))).otherwise(F.col("repository"))
    return folders.select(name(F.col("f")).alias("src_id"), F.lit("WEAK_LINK").alias("rel"), up.alias("dst_id"), "repository")
