"""Percentiles of very large numeric columns by deterministic buffer collapsing (problem 5).

A summary of n values is a set of sorted buffers of ``K`` values; a buffer on level h stands for 2^h times as many values.
Two full buffers of a level collapse into one of the next: their values are merged and every other position is kept (the
odd and the even positions alternate by level). Values that fill no buffer stay as they are, on level 0.

A collapse to level h moves no rank by more than 2^(h-1). At most n / (K 2^h) of them lead to level h, so the rank error is
at most n h_max / (2 K) with h_max = log2(n / K). Each summary carries the exact sum of its own moves as ``err``; up to
2 K - 1 values nothing moves and the percentiles are exact.

Spark builds one summary per group in each partition, and merges summaries in a tree: as many levels as the largest group's
counted summaries need, so that no summary is merged with more than ``FAN_IN`` others at once. Each level is one shuffle, in
which a task merges all its groups in one pass over sorted rows. Summaries of days, partitions or tables combine in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.durable import Workspace

K = 4096
FAN_IN = 32
#: ``sizes`` has the number of loose values and of those of each level, ``data`` all of them as doubles.
SUMMARY = "n bigint, err bigint, low double, high double, sizes array<int>, data binary"
COLUMNS = ["n", "err", "low", "high", "sizes", "data"]


class Buffers:
    """Level h holds at most one full buffer; level 0 also holds the loose values."""

    def __init__(self, k: int = K):
        self.k, self.n, self.err, self.low, self.high = k, 0, 0, np.inf, -np.inf
        self.loose: list[np.ndarray] = []
        self.n_loose = 0
        self.full: dict[int, np.ndarray] = {}

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            other = self.full.pop(level)
            merged = np.sort(np.concatenate([other, buffer]), kind="stable")
            buffer = merged[level % 2 :: 2]
            level += 1
            self.err += 1 << (level - 1)
        self.full[level] = buffer

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        self._add_loose(values)

    def _add_loose(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose < self.k:
            return
        values = np.concatenate(self.loose)
        whole = len(values) // self.k * self.k
        for i in range(0, whole, self.k):
            self._carry(0, np.sort(values[i : i + self.k]))
        self.loose, self.n_loose = [values[whole:]], len(values) - whole

    def merge(self, n: int, err: int, low: float, high: float, levels: list[np.ndarray]) -> None:
        self.n += int(n)
        self.err += int(err)
        self.low, self.high = min(self.low, low), max(self.high, high)
        for level, buffer in enumerate(levels):
            if len(buffer):
                if level:
                    self._carry(level - 1, buffer)
                else:
                    self._add_loose(buffer)

    def levels(self) -> list[np.ndarray]:
        """The loose values, then each level's buffer (empty where there is none)."""
        loose = np.sort(np.concatenate(self.loose)) if self.loose else np.array([])
        return [loose, *(self.full.get(h, np.array([])) for h in range(max(self.full, default=-1) + 1))]

    def row(self) -> tuple:
        levels = self.levels()
        return self.n, self.err, float(self.low), float(self.high), [len(x) for x in levels], np.concatenate(levels).tobytes()


def levels_of(sizes: list[int], data: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(data, dtype="float64"), np.cumsum(sizes)[:-1])


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keys), SUMMARY])


def _plain(x: object) -> object:
    return None if x is None or x is pd.NaT or x != x else x


def summarize(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One summary per group: keys and SUMMARY.

    Null, NaN, infinite and negative values are no measurements; a group without a measurement has no row. Null keys form a
    group. Values and keys are pruned before they leave the JVM.
    """
    rows = df.select(*(F.col(c) for c in keys), F.col(value).cast("double").alias("_value")).where(
        F.col("_value").isNotNull() & ~F.isnan("_value") & (F.col("_value") >= 0) & (F.col("_value") < float("inf"))
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, Buffers] = {}
        for batch in batches:
            code = batch.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            names = batch[keys].iloc[order[starts]].itertuples(index=False, name=None)
            for name, values in zip(names, np.split(batch["_value"].to_numpy()[order], starts[1:]), strict=True):
                name = tuple(map(_plain, name))
                if name not in groups:
                    groups[name] = Buffers(k)
                groups[name].add(values)
        if groups:
            yield pd.DataFrame([(*name, *g.row()) for name, g in groups.items()], columns=[*keys, *COLUMNS])

    return merge(rows.mapInPandas(build, _schema(rows, keys)), keys, k)


def merge(summaries: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Summaries of equal ``keys`` merged in a tree; takes the output of ``summarize`` or of ``merge`` on finer keys.

    The summaries are written and counted per group first. They are dealt to buckets by their place in that table, then to ever
    fewer, so that about ``FAN_IN`` of a group meet at once, however many partitions or days made them and whatever they hold.
    """
    out = Workspace(summaries.sparkSession, "summaries").cut(summaries.select(*keys, *COLUMNS), "parts")
    most = out.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 1
    widths = [1]
    while most > FAN_IN * widths[0]:
        widths.insert(0, widths[0] * FAN_IN)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, total, place = None, None, 0
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False, name=None):
                of = (*map(_plain, row[: len(keys)]), row[-2])
                if of != name:
                    if total is not None:
                        done.append((*name[:-1], *total.row(), place))
                    name, total, place = of, Buffers(k), row[-1]
                n, err, low, high, sizes, data = row[len(keys) : -2]
                total.merge(n, err, low, high, levels_of(sizes, data))
            yield pd.DataFrame(done, columns=[*keys, *COLUMNS, "_place"])
        if total is not None:
            yield pd.DataFrame([(*name[:-1], *total.row(), place)], columns=[*keys, *COLUMNS, "_place"])

    schema = _schema(out, keys) + ", _place bigint"
    out = out.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    for width in widths:
        dealt = out.select(*keys, *COLUMNS, F.pmod("_place", F.lit(width)).alias("_bucket"), "_place")
        out = dealt.repartition(*keys, "_bucket").sortWithinPartitions(*keys, "_bucket", "_place").mapInPandas(combine, schema)
    return out.select(*keys, *COLUMNS)


def _evaluate(levels: list[np.ndarray], n: int, low: float, high: float, ps: list[float]) -> list[float]:
    values = np.concatenate(levels)
    weights = np.concatenate([np.full(len(b), 1 << max(0, i - 1), dtype="int64") for i, b in enumerate(levels)])
    order = np.argsort(values, kind="stable")
    values, ends = values[order], np.cumsum(weights[order])
    out = []
    for p in ps:
        rank = min(n, max(1, int(np.ceil(p * n - 1e-9))))
        out.append(low if rank == 1 else high if rank == n else float(values[np.searchsorted(ends, rank)]))
    return out


def percentiles(summaries: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """keys, p, n, value, rank_error: the value of rank ceil(p n), off by at most ``rank_error`` ranks (0: exact)."""

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                [*(getattr(r, c) for c in keys), p, r.n, v, r.err]
                for r in batch.itertuples(index=False)
                for p, v in zip(ps, _evaluate(levels_of(r.sizes, r.data), r.n, r.low, r.high, ps), strict=True)
            ]
            yield pd.DataFrame(rows, columns=[*keys, "p", "n", "value", "rank_error"])

    types = dict(summaries.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "p double, n bigint, value double, rank_error bigint"])
    return summaries.mapInPandas(evaluate, schema)
