"""Exact cosine search of a set of queries against all vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, PART = 1024, 32_768


def valid_vector(vector: Column, dim: int) -> Column:
    """Of the right length, finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` most similar vectors of each query: query_id, pos, id, score (6 decimals); ties by id, the query itself aside.

    Keys may be of any type that orders. Queries are dealt to blocks of about ``BLOCK``, vectors to parts of about ``PART``; every
    block meets every part in one matrix product, and a part sends at most ``k`` candidates per query on. Only the two counts come
    to the driver. Invalid vectors are no candidates.
    """
    kind = dict(vectors.dtypes)[key]
    pick = lambda df: df.where(valid_vector(F.col(vector), dim)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    vectors, queries = pick(vectors), pick(queries)
    blocks, parts = (-(-df.count() // size) or 1 for df, size in ((queries, BLOCK), (vectors, PART)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", dealt(blocks)).withColumn("part", every(parts))
    right = vectors.withColumn("part", dealt(parts)).withColumn("block", every(blocks))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.array(column.tolist(), dtype="float64").reshape(-1, dim)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("id", ignore_index=True)
        ids, q_ids = v["id"].to_numpy(), q["id"].to_numpy()
        s = np.round(unit(q["v"]) @ unit(v["v"]).T, 6)
        s[q_ids[:, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        # everything as good as the k-th is kept until ties are settled by id, which is the order of the columns
        floor = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n] if n else s
        row, col = np.nonzero((s >= floor) & np.isfinite(s))
        order = np.lexsort((col, -s[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        row, col = row[kept], col[kept]
        return pd.DataFrame({"query_id": q_ids[row], "id": ids[col], "score": s[row, col] + 0.0})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(score, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("query_id", "pos", "id", "score")
