import math

import numpy as np
import pytest

from loomgraph.llm import quantile_buffers as q

PS = [0.01, 0.5, 0.9, 0.99]


def rank_gap(values, value, p):
    """How many ranks ``value`` is away from the wanted rank."""
    v = np.sort(values)
    rank = max(1, math.ceil(p * len(v) - 1e-9))
    low, high = np.searchsorted(v, value, "left") + 1, np.searchsorted(v, value, "right")
    return max(0, low - rank, rank - high)


@pytest.mark.parametrize("shape", ["uniform", "sorted", "reversed", "ties"])
def test_error_stays_within_its_bound(shape):
    rnd = np.random.default_rng(3)
    values = {"uniform": rnd.random(60_000), "sorted": np.arange(60_000.0), "reversed": np.arange(60_000.0)[::-1], "ties": rnd.integers(0, 7, 60_000) * 1.0}[shape]
    whole = q.Buffers(256)
    for i, part in enumerate(np.array_split(values, 37)):
        one = q.Buffers(256)
        for piece in np.array_split(part, 5):
            one.add(piece)
        n, err, low, high, sizes, data = one.row()
        whole.merge(n, err, low, high, q.levels_of(sizes, data))
    n, err, low, high, sizes, data = whole.row()
    assert n == len(values) == sum(m << max(0, i - 1) for i, m in enumerate(sizes))
    got = q._evaluate(q.levels_of(sizes, data), n, low, high, PS)
    assert all(rank_gap(values, v, p) <= err for v, p in zip(got, PS, strict=True))
    assert 0 < err <= len(values) * math.log2(len(values) / 256) / (2 * 256)


def test_spark_groups_and_merging(spark):
    df = spark.range(30_000).selectExpr("id % 5 AS day", "IF(id % 3 = 0, NULL, 'm') AS mode", "CAST(id * 7919 % 30011 AS DOUBLE) AS ms", "id AS n")
    df = df.unionByName(spark.createDataFrame([(0, "m", float("nan"), 0), (0, "m", -1.0, 0), (0, "m", None, 0), (0, "m", float("inf"), 0), (9, "bad", None, 0)], df.schema))
    daily = q.summarize(df.repartition(6), ["mode", "day"], "ms", k=128)
    assert daily.count() == 10
    whole = q.percentiles(q.merge(daily, ["mode"], k=128), ["mode"], PS).collect()
    for r in whole:
        values = [i * 7919 % 30011 for i in range(30_000) if (i % 3 == 0) == (r["mode"] is None)]
        assert r.n == len(values) and rank_gap(np.array(values, dtype=float), r.value, r.p) <= r.rank_error < 0.05 * r.n


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, x double")
    rows = q.percentiles(q.summarize(df, ["g"], "x"), ["g"], [0.0, 0.5, 0.91, 1.0]).collect()
    assert [(r.value, r.rank_error) for r in sorted(rows, key=lambda r: r.p)] == [(1.0, 0), (5.0, 0), (10.0, 0), (10.0, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert q.percentiles(q.summarize(df, ["g"], "x"), ["g"], PS).count() == 0


def test_many_equal_summaries_of_one_group_merge_in_a_tree(spark):
    df = spark.range(20_000).selectExpr("id % 200 AS day", "'m' AS mode", "7.0D AS ms")
    daily = q.summarize(df.repartition(3), ["mode", "day"], "ms", k=16)
    (r,) = q.percentiles(q.merge(daily, ["mode"], k=16), ["mode"], [0.5]).collect()
    assert (r.n, r.value) == (20_000, 7.0)


def test_null_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, 1.0, 5), (None, 3.0, 5), ("a", 2.0, 5)], "n string, x double, err int")
    rows = q.percentiles(q.summarize(df.withColumnRenamed("n", "g"), ["g"], "x"), ["g"], [0.5]).collect()
    assert {(r.g, r.value) for r in rows} == {(None, 1.0), ("a", 2.0)}
