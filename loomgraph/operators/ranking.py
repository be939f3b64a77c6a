"""Ranked lists: weighted reciprocal rank fusion, stable promotion, hits and reciprocal ranks, budgeted packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(lists: DataFrame, keys: list[str], items: str) -> DataFrame:
    """keys, item, rank of an array column: a repeated item uses up its places, but only its first one ranks it."""
    flat = lists.select(*keys, F.posexplode(items).alias("at", "item")).where(F.col("item").isNotNull() & (F.col("item") != ""))
    return flat.groupBy(*keys, "item").agg((F.min("at") + 1).alias("rank"))


def fuse(ranks: DataFrame, group: list[str], weight: Column, k: int = 60) -> DataFrame:
    """group, item, score, lists: the sum of weight / (k + rank) over the lists that hold an item, in whole billionths, so that
    the order of adding up does not matter."""
    part = F.round(weight / (F.lit(k) + F.col("rank")) * 1e9).cast("bigint")
    return ranks.groupBy(*group, "item").agg((F.sum(part) / 1e9).alias("score"), F.count("*").alias("lists"))


def top(scored: DataFrame, group: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "item")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def first_hits(records: DataFrame, key: str, ranking: str, truth: str) -> DataFrame:
    """key and first: the rank of the first item of ``ranking`` that ``truth`` holds (both trimmed, any case); null if none."""
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    hit = F.transform(clean(ranking), lambda x: F.array_contains(clean(truth), x))
    at = F.array_position(hit, F.lit(True)).cast("int")
    return records.select(F.col(key), F.when(at > 0, at).alias("first"))


def pack(records: DataFrame, keys: list[str], items: str, budget: int) -> DataFrame:
    """keys, kept, used: walks the texts in order and keeps each that still fits the budget of characters; others are skipped.

    The fold runs inside the row, over the row's own list.
    """
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("used"))

    def step(acc: Column, text: Column) -> Column:
        size = F.coalesce(F.length(text), F.lit(0))
        fits = (acc["used"] + size <= budget) & text.isNotNull()
        return F.struct((acc["kept"] + fits.cast("int")).alias("kept"), (acc["used"] + F.when(fits, size).otherwise(0)).alias("used"))

    folded = F.aggregate(F.coalesce(F.col(items), F.array().cast("array<string>")), start, step)
    return records.select(*keys, folded.alias("p")).select(*keys, "p.kept", "p.used")
