"""Exact percentiles with linear interpolation, without gathering a group: counts by coarse bin, then by the fine bins of those
that hold a wanted rank, then by value within the few fine bins that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Coarse bins are 1/64 of a doubling, of which doubles have at most 1 024; each has so many fine ones.
PER_DOUBLING, FINE = 64, 4096


def _with_ranks(counts: DataFrame, within: list[str], by: str, base: Column) -> DataFrame:
    """Adds first and end: the ranks that the ``n`` values of each row take."""
    upto = base + F.sum("n").over(Window.partitionBy(*within).orderBy(by))
    return counts.withColumn("end", upto).withColumn("first", F.col("end") - F.col("n"))


def _holding(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted ranks with the row of ``rows`` that holds each: wanted columns, keys and base (the row's first rank)."""
    right = rows.select(*(F.col(c).alias(f"_{c}") for c in keys), "first", "end")
    shared = [c for c in keys if c in wanted.columns]
    on = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    for c in shared:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    new = [F.col(f"_{c}").alias(c) for c in keys if c not in shared]
    return wanted.drop("base").join(right, on).select(*(c for c in wanted.columns if c != "base"), *new, F.col("first").alias("base"))


def _inside(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The values that share ``keys`` with a wanted rank, with the rank at which their bin begins."""
    w = wanted.select(*(F.col(c).alias(f"_{c}") for c in keys), "base").distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return values.join(w, on).drop(*(f"_{c}" for c in keys))


def exact_percentiles(df: DataFrame, group: str, value: str, ps: list[float]) -> DataFrame:
    """group, p, value: null, NaN, infinite and negative values are left out; a null group is a group of its own."""
    v = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0) & (F.col("v") < float("inf"))
    )
    v = v.withColumn("bin", F.floor(F.log2(F.col("v") + 1) * PER_DOUBLING))
    low, high = F.pow(F.lit(2.0), F.col("bin") / PER_DOUBLING) - 1, F.pow(F.lit(2.0), (F.col("bin") + 1) / PER_DOUBLING) - 1
    v = v.withColumn("fine", F.floor((F.col("v") - low) / (high - low) * FINE))

    bins = _with_ranks(v.groupBy("g", "bin").agg(F.count("*").alias("n")), ["g"], "bin", F.lit(0))
    totals = bins.groupBy("g").agg(F.sum("n").alias("count")).select("g", "count", F.explode(F.lit(ps)).alias("p"))
    place = F.col("p") * (F.col("count") - 1)
    wanted = totals.select("g", "p", place.alias("place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    wanted = _holding(bins, wanted.withColumn("base", F.lit(0)), ["g", "bin"])

    fine = _inside(v, wanted, ["g", "bin"]).groupBy("g", "bin", "base", "fine").agg(F.count("*").alias("n"))
    wanted = _holding(_with_ranks(fine, ["g", "bin"], "fine", F.col("base")), wanted, ["g", "bin", "fine"])

    single = _inside(v, wanted, ["g", "bin", "fine"]).groupBy("g", "bin", "fine", "base", "v").agg(F.count("*").alias("n"))  # ties are one row
    got = _holding(_with_ranks(single, ["g", "bin", "fine"], "v", F.col("base")), wanted, ["g", "bin", "fine", "v"])
    low, high = F.min("v"), F.max("v")
    share = F.first("place") - F.floor(F.first("place"))
    return got.groupBy("g", "p").agg(F.round(low + (high - low) * share, 6).alias("value")).withColumnRenamed("g", group)
