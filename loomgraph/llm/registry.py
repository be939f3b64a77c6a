"""Queries of the problems on text and model data, with SQL where it can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import answer_defects as p6
from loomgraph.llm import encode as p7
from loomgraph.llm import garbled as p9
from loomgraph.llm import leaks as p8
from loomgraph.llm import quantile_buffers as p5
from loomgraph.llm import sources as p2
from loomgraph.sources.tables import table

FILE_COLUMNS = ["file_id", "repository", "file_path", "content"]
PERCENTILES = [0.5, 0.9, 0.95, 0.99]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2.parse_files(table(spark, folder, "source_files", *FILE_COLUMNS)).where(~F.col("accepted")).select("file_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return p2.acceptance(p2.parse_files(table(spark, folder, "source_files", *FILE_COLUMNS)))


def p2_errors(spark: SparkSession, folder: str) -> DataFrame:
    parsed = p2.parse_files(table(spark, folder, "source_files", *FILE_COLUMNS)).where(~F.col("accepted"))
    return parsed.select("file_id", "language", "line", "cause", F.size("errors").alias("n_errors"))


def p2_chunks(spark: SparkSession, folder: str) -> DataFrame:
    parsed = p2.parse_files(table(spark, folder, "source_files", *FILE_COLUMNS))
    return p2.broken_chunks(parsed, table(spark, folder, "chunks", "node_id", "chunk_index", "repository", "file_path"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2.documented_functions(table(spark, folder, "source_files", *FILE_COLUMNS)).select("file_id", "line", "name")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return p2.documented_functions(table(spark, folder, "source_files", *FILE_COLUMNS))


def _latencies(spark: SparkSession, folder: str) -> DataFrame:
    """metric, mode, day, ms of both latencies. Repeated rows count once."""
    records = table(
        spark, folder, "answer_records", "record_id", "mode", "recorded_at", "retrieval_latency_ms", "generation_latency_ms"
    ).dropDuplicates(["record_id"])
    return records.select(
        "mode",
        F.to_date("recorded_at").cast("string").alias("day"),
        F.expr("stack(2, 'retrieval', retrieval_latency_ms, 'generation', generation_latency_ms) AS (metric, ms)"),
    )


def latency_summaries(spark: SparkSession, folder: str, k: int = p5.K) -> DataFrame:
    """Daily summaries: metric, mode, day and the buffers."""
    return p5.summarize(_latencies(spark, folder), ["metric", "mode", "day"], "ms", k)


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per metric and mode, from the daily summaries combined."""
    whole = p5.merge(latency_summaries(spark, folder), ["metric", "mode"])
    return p5.percentiles(whole, ["metric", "mode"], PERCENTILES)


def p5_daily_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return p5.percentiles(latency_summaries(spark, folder), ["metric", "mode", "day"], PERCENTILES)


def p5_bounded(spark: SparkSession, folder: str, k: int = 32) -> DataFrame:
    """Percentiles from daily summaries with small buffers, held against the ranks that their values take in the whole column:
    metric, mode, p, n, collapsed (buffers were collapsed), within (the rank is off by at most rank_error)."""
    got = p5.percentiles(p5.merge(latency_summaries(spark, folder, k), ["metric", "mode"], k), ["metric", "mode"], PERCENTILES)
    m = F.col("ms")
    data = _latencies(spark, folder).where(m.isNotNull() & ~F.isnan(m) & (m >= 0) & (m < float("inf"))).select(F.col("metric").alias("d_metric"), F.col("mode").alias("d_mode"), "ms")
    on = (F.col("metric") == F.col("d_metric")) & F.col("mode").eqNullSafe(F.col("d_mode"))
    ranks = data.join(F.broadcast(got), on).groupBy("metric", "mode", "p", "n", "rank_error").agg(
        F.count_if(F.col("ms") < F.col("value")).alias("below"), F.count_if(F.col("ms") <= F.col("value")).alias("upto")
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") - 1e-9))
    off = F.greatest(F.lit(0), F.col("below") + 1 - wanted, wanted - F.col("upto"))
    return ranks.select("metric", "mode", "p", "n", (F.col("rank_error") > 0).alias("collapsed"), (off <= F.col("rank_error")).alias("within"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "answer_records", "record_id", "question", "answer", "completion_tokens")
    return p6.answer_defects(records).select("record_id", "defect")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "answer_records", "record_id", "mode", "question", "answer", "completion_tokens")
    return p6.defect_rates(records)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return p7.encode(table(spark, folder, "documents", "doc_id", "text"))


def p7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens per language and kind."""
    documents = table(spark, folder, "documents", "doc_id", "text", "lang", "kind")
    counted = p7.encode(documents, also=["lang", "kind"]).select("lang", "kind", F.size("ids").cast("bigint").alias("n"))
    return counted.groupBy("lang", "kind").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "gold_cases"))


def p8_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    return p8.reparameterised(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "gold_cases"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The cases that share the templates of each class of p8_reparameterised."""
    return p8.classes(table(spark, folder, "gold_cases"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9.garbled(table(spark, folder, "documents", "doc_id", "text")).select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return p9.garbled(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_errors": p2_errors,
    "p2_chunks": p2_chunks,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p5_percentiles": p5_percentiles,
    "p5_daily_percentiles": p5_daily_percentiles,
    "p5_bounded": p5_bounded,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
    "p7_token_counts": p7_token_counts,
    "p8_found": p8_found,
    "p8_reparameterised": p8_reparameterised,
    "p8_classes": p8_classes,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}


def _percentile_sql(keys: str) -> str:
    # the value of rank ceil(p n); exact for groups of fewer than 2 K values
    return f"""
    WITH r AS (SELECT DISTINCT record_id, mode, recorded_at, retrieval_latency_ms, generation_latency_ms FROM answer_records),
    v AS (SELECT 'retrieval' AS metric, mode, CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS day, retrieval_latency_ms AS ms FROM r
          UNION ALL SELECT 'generation', mode, CAST(CAST(recorded_at AS DATE) AS VARCHAR), generation_latency_ms FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms) AS rank, count(*) OVER (PARTITION BY {keys}) AS n
          FROM v WHERE ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0 AND ms < 'Infinity'::DOUBLE)
    SELECT {keys}, p, n, ms AS value, CAST(0 AS BIGINT) AS rank_error
    FROM k, (SELECT unnest([0.5::DOUBLE, 0.9, 0.95, 0.99]) AS p) WHERE rank = greatest(1, CAST(ceil(p * n - 1e-9) AS BIGINT))"""


SQL = {
    "p5_percentiles": _percentile_sql("metric, mode"),
    "p5_daily_percentiles": _percentile_sql("metric, mode, day"),
    # buffers of k values collapse as soon as two are full
    "p5_bounded": _percentile_sql("metric, mode").replace("ms AS value, CAST(0 AS BIGINT) AS rank_error", "n >= 64 AS collapsed, true AS within"),
    "p8_found": """
    WITH p AS (SELECT id AS case_id, unnest([question, reference_answer] || coalesce(reference_contexts, [])) AS text FROM gold_cases),
    g AS (SELECT case_id, regexp_extract_all(lower(upper(text)), '[\\p{L}\\p{N}]+') AS w FROM p WHERE text IS NOT NULL),
    d AS (SELECT doc_id, regexp_extract_all(lower(upper(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    gw AS (SELECT DISTINCT case_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM g)),
    dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM d))
    SELECT DISTINCT doc_id, case_id FROM dw JOIN gw USING (s)""",
}
