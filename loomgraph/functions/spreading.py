"""Work that costs far more than reading should not be tied to the splits of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table of few files and row groups gives few splits, and a costly expression would leave most cores idle. Such a scan is
    dealt out round-robin; a scan with enough splits, as any large table has, stays as it is and nothing is shuffled. Takes
    plans without an exchange (a scan, filters and projections).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
