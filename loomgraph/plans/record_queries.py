"""Queries over answer records, evaluation cases, vectors, texts and sources, with SQL that states the same results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text as X
from loomgraph.operators import code, evaluation, ranking
from loomgraph.operators.percentile import exact_percentiles
from loomgraph.operators.retrieval import contexts, expanded, fuse_rows, retrieve, target_ranks
from loomgraph.operators.vectors import cosine_top_k
from loomgraph.sources.files import anchor_excerpts, normal_path, snapshot_changes
from loomgraph.sources.graph import VIEWS, graph
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cosine(where: str) -> str:
    return f"""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
    s AS (SELECT q.id AS query_id, v.id, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(v.v, v.v)), 6) AS score
          FROM v q JOIN v ON v.id <> q.id WHERE q.id % 100 = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM s)"""


@query(_cosine("true") + " SELECT query_id, pos, id, score FROM r WHERE pos <= 10")
def cosine_top10(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    return cosine_top_k(v, v.where("vec_id % 100 = 0"), 10, DIM)


@query(_cosine("v.label = 3") + " SELECT query_id, pos, id, score FROM r WHERE pos <= 10")
def cosine_top10_filtered(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    return cosine_top_k(v.where("label = 3"), v.where("vec_id % 100 = 0"), 10, DIM)


@query(_cosine("true") + """, t AS (SELECT r.query_id, min(r.pos) FILTER (WHERE a.label = b.label) AS first FROM r JOIN v a ON a.id = r.query_id JOIN v b ON b.id = r.id WHERE pos <= 10 GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(CAST(coalesce(first, 99) <= 1 AS INT)), 6) AS hit_1, round(avg(CAST(coalesce(first, 99) <= 5 AS INT)), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM t""")
def cosine_label_hits(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    found = cosine_top_k(v, v.where("vec_id % 100 = 0"), 10, DIM)
    labels = v.select(F.col("vec_id").cast("long").alias("vec"), "label")
    a, b = labels.toDF("a_id", "a_label"), labels.toDF("b_id", "b_label")
    hit = found.join(a, F.col("query_id") == F.col("a_id")).join(b, F.col("id") == F.col("b_id"))
    first = hit.groupBy("query_id").agg(F.min(F.when(F.col("a_label") == F.col("b_label"), F.col("pos"))).alias("first"))
    return _hit_rates(first)


def _hit_rates(first: DataFrame, *keys: str) -> DataFrame:
    hit = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6).alias(f"hit_{k}")
    return first.groupBy(*keys).agg(
        F.count("*").alias("queries"), hit(1), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


_RECORDS = "r AS (SELECT DISTINCT ON (record_id) * FROM answer_records)"
_FIRST = """, x AS (SELECT record_id, mode, case_id, unnest(retrieved_files) AS f, generate_subscripts(retrieved_files, 1) AS pos, source_files FROM r),
h AS (SELECT record_id, min(pos) AS first FROM x WHERE list_contains(list_transform(source_files, lambda s: lower(trim(s))), lower(trim(f))) GROUP BY 1),
f AS (SELECT r.record_id, r.mode, r.case_id, h.first FROM r LEFT JOIN h ON h.record_id = r.record_id WHERE len(r.source_files) > 0)"""
_RATES = "CAST(count(*) AS BIGINT) AS queries, round(avg(CAST(coalesce(first, 99) <= 1 AS INT)), 6) AS hit_1, round(avg(CAST(coalesce(first, 99) <= 5 AS INT)), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr"


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "answer_records", "record_id", *columns).dropDuplicates(["record_id"])


@query("WITH " + _RECORDS + _FIRST + f" SELECT mode, difficulty, {_RATES} FROM f JOIN gold_cases g ON g.id = f.case_id GROUP BY GROUPING SETS ((mode, difficulty), (mode), ())")
def retrieval_hits(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder, "mode", "case_id", "retrieved_files", "source_files").where(F.size("source_files") > 0)
    first = ranking.first_hits(records, "record_id", "retrieved_files", "source_files")
    cases = table(spark, folder, "gold_cases", "id", "difficulty")
    joined = first.join(records.select("record_id", "mode", "case_id"), "record_id").join(cases, F.col("case_id") == F.col("id"))
    hit = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6).alias(f"hit_{k}")
    return joined.groupingSets([["mode", "difficulty"], ["mode"], []], "mode", "difficulty").agg(
        F.count("*").alias("queries"), hit(1), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


@query("WITH " + _RECORDS + """, x AS (SELECT record_id, mode, case_id, unnest(retrieved_files) AS item, generate_subscripts(retrieved_files, 1) AS pos FROM r),
k AS (SELECT record_id, mode, case_id, item, min(pos) AS rank FROM x WHERE item <> '' GROUP BY ALL),
s AS (SELECT case_id, item, CAST(sum(CAST(round(CASE mode WHEN 'graph' THEN 1.5 ELSE 1.0 END / (60 + rank) * 1e9) AS HUGEINT)) AS BIGINT) / 1e9 AS score, count(*) AS lists FROM k GROUP BY 1, 2)
SELECT case_id, item, score, lists, pos FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item) AS pos FROM s) WHERE pos <= 20""")
def fused_files(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder, "mode", "case_id", "retrieved_files")
    ranks = ranking.ranked(records, ["record_id", "mode", "case_id"], "retrieved_files")
    weight = F.when(F.col("mode") == "graph", 1.5).otherwise(1.0)
    return ranking.top(ranking.fuse(ranks, ["case_id"], weight), ["case_id"], 20)


def _finite(c: str) -> str:
    return f"CASE WHEN isnan({c}) OR {c} < 0 OR {c} = 'Infinity'::DOUBLE THEN NULL ELSE {c} END"


@query("WITH " + _RECORDS + f""", v AS (SELECT mode, {_finite('retrieval_latency_ms')} AS ms FROM r)
SELECT mode, p, round(quantile_cont(ms, p), 6) AS value FROM v, (SELECT unnest([0.5::DOUBLE, 0.95, 0.99]) AS p) WHERE ms IS NOT NULL GROUP BY mode, p""".replace("quantile_cont(ms, p)", "list_extract(quantile_cont(ms, [0.5, 0.95, 0.99]), CASE p WHEN 0.5 THEN 1 WHEN 0.95 THEN 2 ELSE 3 END)"))
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return exact_percentiles(_records(spark, folder, "mode", "retrieval_latency_ms"), "mode", "retrieval_latency_ms", [0.5, 0.95, 0.99])


def _mean(c: str) -> Column:
    """The mean of a column to 6 decimals, from whole millionths: the same in whatever order rows are added."""
    total, n = F.sum(F.round(F.col(c) * 1e6).cast("decimal(28,0)")), F.nullif(F.count(c), F.lit(0))
    return F.floor((total * 2 + n) / (n * 2)).cast("bigint") / 1e6


def _mean_sql(c: str) -> str:
    return f"CAST((2 * sum(CAST(round({c} * 1e6) AS HUGEINT)) + count({c})) // nullif(2 * count({c}), 0) AS DOUBLE) / 1e6"


def _sum(c: str) -> Column:
    return F.sum(F.round(F.col(c) * 1e9).cast("decimal(28,0)")).cast("bigint") / 1e9


def _sum_sql(c: str) -> str:
    return f"CAST(sum(CAST(round({c} * 1e9) AS HUGEINT)) AS BIGINT) / 1e9"


def _measured(c: str) -> Column:
    x = F.col(c)
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def _score(c: str) -> Column:
    """A score that is finite and between 0 and 1; null otherwise."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (x >= 0) & (x <= 1), x)


def _score_sql(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} <= 1 THEN {c} END"


SCORES = ["source_hit", "faithfulness", "answer_relevancy", "answer_correctness"]
AMOUNTS = ["retrieval_latency_ms", "generation_latency_ms"]
TOKENS = ["prompt_tokens", "completion_tokens"]
MEANS = [*SCORES, *AMOUNTS, *TOKENS]
_MODE_MEANS = "WITH " + _RECORDS + ", v AS (SELECT mode, " + ", ".join(
    [f"{_score_sql(c)} AS {c}" for c in SCORES] + [f"{_finite(c)} AS {c}" for c in [*AMOUNTS, "estimated_api_cost_usd"]] + TOKENS
) + " FROM r), s AS (SELECT mode, count(*) AS records, " + ", ".join(f"{_mean_sql(c)} AS {c}" for c in MEANS) + f""",
CASE WHEN count(estimated_api_cost_usd) = count(*) THEN {_sum_sql("estimated_api_cost_usd")} END AS cost,
round((sum(prompt_tokens) * 0.15 + sum(completion_tokens) * 0.6) / 1e6, 6) AS modelled_cost FROM v GROUP BY mode)"""


def _mode_means(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder, "mode", *MEANS, "estimated_api_cost_usd")
    v = r.select(
        "mode", *(_score(c).alias(c) for c in SCORES), *(_measured(c).alias(c) for c in [*AMOUNTS, "estimated_api_cost_usd"]), *TOKENS
    )
    usd = F.col("estimated_api_cost_usd")
    return v.groupBy("mode").agg(
        F.count("*").alias("records"), *(_mean(c).alias(c) for c in MEANS),
        F.when(F.count(usd) == F.count("*"), _sum("estimated_api_cost_usd")).alias("cost"),
        F.round((F.sum("prompt_tokens") * 0.15 + F.sum("completion_tokens") * 0.6) / 1e6, 6).alias("modelled_cost"),
    )


@query(_MODE_MEANS + " SELECT *, round(cost / records, 9) AS cost_per_answer FROM s")
def mode_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per mode: records, means of scores, latencies and tokens, cost in all (null if one is missing) and by answer."""
    return _mode_means(spark, folder).withColumn("cost_per_answer", F.round(F.col("cost") / F.col("records"), 9))


@query(_MODE_MEANS + ", d AS (" + " UNION ALL ".join(f"SELECT mode, '{c}' AS measure, {c} AS value FROM s" for c in MEANS)
+ """) SELECT measure, max(value) FILTER (WHERE mode = 'hybrid') AS hybrid, max(value) FILTER (WHERE mode = 'vector') AS vector,
round(max(value) FILTER (WHERE mode = 'hybrid') - max(value) FILTER (WHERE mode = 'vector'), 6) AS delta FROM d GROUP BY measure""")
def mode_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """What hybrid gains over vector retrieval, by measure."""
    long = _mode_means(spark, folder).unpivot(["mode"], MEANS, "measure", "value")
    by = long.groupBy("measure").pivot("mode", ["hybrid", "vector"]).agg(F.max("value"))
    return by.select("measure", "hybrid", "vector", F.round(F.col("hybrid") - F.col("vector"), 6).alias("delta"))


_CASES = "WITH " + _RECORDS + f""", x AS (SELECT case_id, mode, {_score_sql('answer_correctness')} AS c FROM r WHERE mode IN ('hybrid', 'vector')),
m AS (SELECT case_id, mode, {_mean_sql('c')} AS c FROM x GROUP BY 1, 2),
p AS (SELECT case_id, max(c) FILTER (WHERE mode = 'hybrid') AS hybrid, max(c) FILTER (WHERE mode = 'vector') AS vector FROM m GROUP BY 1)"""


def _case_means(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder, "case_id", "mode", "answer_correctness").where("mode IN ('hybrid', 'vector')")
    r = r.select("case_id", "mode", _score("answer_correctness").alias("c"))
    return r.groupBy("case_id").pivot("mode", ["hybrid", "vector"]).agg(_mean("c"))


@query(_CASES + " SELECT case_id, hybrid, vector, round(hybrid - vector, 6) AS delta FROM p")
def case_means(spark: SparkSession, folder: str) -> DataFrame:
    h, v = F.col("hybrid"), F.col("vector")
    return _case_means(spark, folder).select("case_id", "hybrid", "vector", F.round(h - v, 6).alias("delta"))


@query()
def bootstrap_interval(spark: SparkSession, folder: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the mean hybrid - vector difference: mean, low, high, cases. Cases are few at every scale; above
    100 000 the operator refuses to broadcast them."""
    rows = _case_means(spark, folder).select((F.col("hybrid") - F.col("vector")).alias("d"), "case_id").where("d IS NOT NULL").orderBy("case_id").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many cases to resample on every executor")
    deltas = spark.sparkContext.broadcast(np.array([r["d"] for r in rows]))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = deltas.value
        for batch in batches:
            means = [np.random.default_rng((seed, i)).choice(d, len(d)).mean() if len(d) else np.nan for i in batch["id"]]
            yield pd.DataFrame({"mean": means})

    means = spark.range(resamples).mapInPandas(resample, "mean double")
    d = deltas.value
    return means.agg(
        F.lit(float(d.mean()) if len(d) else None).cast("double").alias("mean"), F.expr("percentile(mean, 0.025)").alias("low"),
        F.expr("percentile(mean, 0.975)").alias("high"), F.lit(len(d)).alias("cases"),
    )


@query("""WITH q AS (SELECT DISTINCT question FROM answer_records WHERE question IS NOT NULL)
SELECT question, CASE WHEN regexp_matches(lower(question), '(docker|yaml|yml|readme|config|compose|port|host|k8s|deploy|setup|install)') THEN 'non_code' ELSE 'code' END AS routed,
regexp_matches(question, '(?i)\\b(method resolution order|mro)\\b') AS asks_mro, array_to_string(list_distinct(regexp_extract_all(question, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1)), ',') AS snake FROM q""".replace("array_to_string(list_distinct(regexp_extract_all(question, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1)), ',') AS snake", "CAST(len(list_distinct(regexp_extract_all(question, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1))) AS INT) AS snake"))
def question_routing(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("question")
    snake = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(X.SNAKE), 1)))
    questions = table(spark, folder, "answer_records", "question").where("question IS NOT NULL").distinct()
    return questions.select(q, X.routed_type(q).alias("routed"), q.rlike(r"(?i)\b(?:method resolution order|mro)\b").alias("asks_mro"), snake.alias("snake"))


def _intent_sql(k: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(question, '(?i){x[0]}') THEN {repr(x[k])}" for x in X.RELATION_QUESTIONS)
    return f"CASE {cases} END"


@query(f"""WITH q AS (SELECT DISTINCT question FROM answer_records WHERE question IS NOT NULL UNION SELECT question FROM gold_cases)
SELECT question, regexp_matches(question, '(?i)\\b(?:{"|".join(X.GLOBAL_QUESTIONS)})\\b') AS is_global, {_intent_sql(1)} AS rel, {_intent_sql(2)} AS direction, {_intent_sql(3)} AS hops,
len(list_distinct(regexp_extract_all(question, '{X.SNAKE}', 1))) AS snakes FROM q""")
def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("question")
    asked = table(spark, folder, "answer_records", "question").where("question IS NOT NULL").union(table(spark, folder, "gold_cases", "question")).distinct()
    intent = X.relation_intent(q)
    snakes = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(X.SNAKE), 1))).cast("bigint")
    return asked.select(q, X.is_global(q).alias("is_global"), intent["rel"].alias("rel"), intent["direction"].alias("direction"), intent["hops"].alias("hops"), snakes.alias("snakes"))


@query()
def question_analysis(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("question")
    questions = table(spark, folder, "answer_records", "question").where("question IS NOT NULL").distinct()
    intent = X.relation_intent(q)
    return questions.select(
        q, X.is_global(q).alias("is_global"), X.query_type(q).alias("query_type"), intent["rel"].alias("rel"), intent["direction"].alias("direction"),
        F.coalesce(X.hop_bound(q), intent["hops"]).alias("hops"), X.target_label(q).alias("target_label"),
        F.array_join(X.entities(q), ",").alias("entities"), F.array_join(X.keywords(q), ",").alias("keywords"),
    )


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS word FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS documents FROM w WHERE regexp_matches(word, '\\p{L}') AND NOT list_contains(string_split('%s', ' '), word) GROUP BY word""" % " ".join(X.STOP_WORDS))
def keyword_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents", "text").where("text IS NOT NULL").select(F.explode(X.keywords(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("documents"))


@query()
def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return code.windows(table(spark, folder, "source_files", "file_id", "content")).drop("text")


@query()
def source_graph(spark: SparkSession, folder: str) -> DataFrame:
    return code.extract(table(spark, folder, "source_files", "repository", "file_path", "content"))


@query("""WITH RECURSIVE r AS (SELECT DISTINCT ON (record_id) record_id, coalesce(contexts, []) AS c FROM answer_records),
f AS (SELECT record_id, c, 0 AS i, 0 AS kept, 0 AS used FROM r
      UNION ALL SELECT record_id, c, i + 1, kept + CAST(coalesce(used + length(c[i + 1]) <= 600, false) AS INT),
        used + CASE WHEN coalesce(used + length(c[i + 1]) <= 600, false) THEN CAST(length(c[i + 1]) AS INT) ELSE 0 END FROM f WHERE i < len(c))
SELECT record_id, kept, used FROM f WHERE i = len(c)""")
def packed_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.pack(_records(spark, folder, "contexts"), ["record_id"], "contexts", 600)


@query("""WITH a AS (SELECT id, unnest(source_anchors) AS anchor FROM gold_cases),
p AS (SELECT DISTINCT id, regexp_extract(anchor, '^(.*):(\\d+)-(\\d+)$', 1) AS file, CAST(regexp_extract(anchor, '^(.*):(\\d+)-(\\d+)$', 2) AS INT) AS first,
  CAST(regexp_extract(anchor, '^(.*):(\\d+)-(\\d+)$', 3) AS INT) AS last FROM a WHERE regexp_matches(anchor, '^.*:\\d+-\\d+$')),
i AS (SELECT *, first - CAST(dense_rank() OVER (PARTITION BY file, last - first ORDER BY first) AS INT) AS island FROM p)
SELECT file, last - first AS width, island, count(*) AS anchors, count(DISTINCT id) AS cases, min(first) AS start FROM i GROUP BY ALL""")
def anchor_runs(spark: SparkSession, folder: str) -> DataFrame:
    pattern = r"^(.*):(\d+)-(\d+)$"
    a = table(spark, folder, "gold_cases", "id", "source_anchors").select("id", F.explode("source_anchors").alias("anchor")).where(F.col("anchor").rlike(pattern))
    part = lambda k: F.regexp_extract("anchor", pattern, k)
    p = a.select("id", part(1).alias("file"), part(2).cast("int").alias("first"), part(3).cast("int").alias("last")).distinct().withColumn("width", F.col("last") - F.col("first"))
    island = F.col("first") - F.dense_rank().over(Window.partitionBy("file", "width").orderBy("first"))
    return p.withColumn("island", island).groupBy("file", "width", "island").agg(
        F.count("*").alias("anchors"), F.count_distinct("id").alias("cases"), F.min("first").alias("start")
    )


@query("""WITH q AS (SELECT id, regexp_replace(regexp_replace(lower(trim(question)), '\\d+', 'N', 'g'), '\\s+', ' ', 'g') AS norm, question, reference_answer, source_anchors, source_files FROM gold_cases)
SELECT count(*) AS cases, count(DISTINCT norm) AS questions, count(*) FILTER (WHERE trim(coalesce(reference_answer, '')) = '') AS unanswered,
count(*) FILTER (WHERE len(source_anchors) <> len(source_files)) AS uneven, count(*) FILTER (WHERE list_bool_and(list_transform(source_anchors, lambda a: regexp_matches(a, '^.+:\\d+-\\d+$')))) AS anchored FROM q""")
def gold_quality(spark: SparkSession, folder: str) -> DataFrame:
    norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("question")), r"\d+", "N"), r"\s+", " ")
    return table(spark, folder, "gold_cases").agg(
        F.count("*").alias("cases"), F.count_distinct(norm).alias("questions"),
        F.count_if(F.trim(F.coalesce("reference_answer", F.lit(""))) == "").alias("unanswered"),
        F.count_if(F.size("source_anchors") != F.size("source_files")).alias("uneven"),
        F.count_if(F.forall("source_anchors", lambda a: a.rlike(r"^.+:\d+-\d+$"))).alias("anchored"),
    )


@query("""WITH a AS (SELECT g.id, unnest(source_files) AS file FROM gold_cases g) SELECT file, count(*) AS cases, count(*) > 15 AS crowded FROM a GROUP BY file""")
def gold_file_load(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "gold_cases", "source_files").select(F.explode("source_files").alias("file"))
    return a.groupBy("file").agg(F.count("*").alias("cases"), (F.count("*") > 15).alias("crowded"))


@query("""SELECT repository, lower(regexp_extract(file_path, '\\.([^.]+)$', 1)) AS ext, CAST(count(DISTINCT file_id) AS BIGINT) AS files,
CAST(sum(len(content) // 4) AS BIGINT) AS tokens FROM (SELECT DISTINCT file_id, repository, file_path, content FROM source_files) GROUP BY 1, 2""".replace("len(content)", "length(content)"))
def token_footprint(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files", "file_id", "repository", "file_path", "content").select(
        "file_id", "repository", F.lower(F.regexp_extract("file_path", r"\.([^.]+)$", 1)).alias("ext"), X.token_estimate(F.col("content")).alias("n")
    ).dropDuplicates(["file_id"])
    return files.groupBy("repository", "ext").agg(F.count("*").alias("files"), F.sum("n").alias("tokens"))


@query("""WITH f AS (SELECT DISTINCT repository, file_path, sha256(content) AS digest FROM source_files WHERE content IS NOT NULL),
g AS (SELECT *, sha256(coalesce(file_path, '') || chr(31) || digest) AS whole FROM f)
SELECT repository, count(*) AS files, count(DISTINCT digest) AS contents,
CAST(sum(CAST('0x' || substr(whole, 1, 15) AS HUGEINT)) % 2305843009213693951 AS BIGINT) AS digest,
CAST(sum(CAST('0x' || substr(whole, 16, 15) AS HUGEINT)) % 2305843009213693921 AS BIGINT) AS digest_2 FROM g GROUP BY 1""")
def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Two digests of each repository over its paths and contents: sums of 60 bits of each file's digest modulo two primes.
    Unlike a digest of the sorted list they combine map-side, so a repository of any size is never gathered."""
    f = table(spark, folder, "source_files", "repository", "file_path", "content").where("content IS NOT NULL")
    f = f.select("repository", "file_path", F.sha2("content", 256).alias("digest")).distinct()
    f = f.withColumn("whole", F.sha2(F.concat(F.coalesce("file_path", F.lit("")), F.lit("\u001f"), "digest"), 256))
    part = lambda at: F.sum(F.conv(F.substring("whole", at, 15), 16, 10).cast("decimal(20,0)"))
    modulo = lambda x, m: (x % F.lit(m).cast("decimal(20,0)")).cast("bigint")
    return f.groupBy("repository").agg(
        F.count("*").alias("files"), F.count_distinct("digest").alias("contents"),
        modulo(part(1), 2305843009213693951).alias("digest"), modulo(part(16), 2305843009213693921).alias("digest_2"),
    )


@query("""SELECT sha256(mode || chr(31) || question) AS key, CAST(count(DISTINCT record_id) AS BIGINT) AS records FROM answer_records WHERE mode IS NOT NULL AND question IS NOT NULL GROUP BY 1""")
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "answer_records", "record_id", "mode", "question").where("mode IS NOT NULL AND question IS NOT NULL")
    return r.groupBy(X.cache_key(F.col("mode"), F.col("question")).alias("key")).agg(F.count_distinct("record_id").alias("records"))


@query("""WITH o AS (SELECT event_type, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, CAST(max(epoch_us(ts) - epoch_us(before)) AS BIGINT) AS longest_gap_us FROM o GROUP BY 1""")
def longest_gaps(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))
    e = table(spark, folder, "events", "event_id", "event_type", "user_id", "ts")
    return e.withColumn("gap", gap).groupBy("event_type").agg(F.max("gap").alias("longest_gap_us"))


@query()
def hybrid_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """The fused answers to every question that was asked; ``qid`` is the question."""
    asked = table(spark, folder, "answer_records", "question").where("question <> ''").distinct()
    n, e = graph(spark, folder)
    return retrieve(asked.select(F.col("question").alias("qid"), "question"), n, e)


@query("""WITH d AS (SELECT repository, file_path, file_id, sha256(content) AS digest, loaded_at FROM source_files),
o AS (SELECT repository, file_path, max_by(coalesce(digest, ''), (loaded_at, file_id)) AS digest FROM d WHERE loaded_at < TIMESTAMP '2025-06-01' GROUP BY 1, 2),
w AS (SELECT repository, file_path, max_by(coalesce(digest, ''), (loaded_at, file_id)) AS digest FROM d GROUP BY 1, 2),
a AS (SELECT * FROM o WHERE digest <> ''), b AS (SELECT * FROM w WHERE digest <> '')
SELECT coalesce(a.repository, b.repository) AS repository, coalesce(a.file_path, b.file_path) AS file_path,
CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.repository = b.repository AND a.file_path = b.file_path WHERE a.digest IS DISTINCT FROM b.digest""")
def snapshot_differences(spark: SparkSession, folder: str) -> DataFrame:
    """What the files loaded since June changed: the last row of each path before June against the last of all; a last row
    without content is a deleted file."""
    files = table(spark, folder, "source_files", "file_id", "repository", "file_path", "content", "loaded_at")
    files = files.select("repository", "file_path", F.coalesce(F.sha2("content", 256), F.lit("")).alias("digest"), "loaded_at", "file_id")
    last = lambda df: df.groupBy("repository", "file_path").agg(F.max_by("digest", F.struct("loaded_at", "file_id")).alias("digest")).where("digest <> ''")
    return snapshot_changes(last(files.where("loaded_at < TIMESTAMP '2025-06-01'")), last(files))


def _damaged(cases: DataFrame) -> DataFrame:
    """Every case as it is, and once for each way to damage it."""
    ways = cases.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    k, none = F.col("k"), F.array().cast("array<string>")
    put = lambda n, c, value: F.when(k == n, value).otherwise(F.col(c)).alias(c)
    first = F.get("source_files", F.lit(0))
    anchors = (
        F.when(k == 4, F.transform("source_anchors", lambda a: F.replace(a, F.lit(":"), F.lit(" ")))).when(k == 5, F.array(F.lit("elsewhere.py:1-2")))
        .when(k == 6, F.array(F.concat(first, F.lit(":9-3")))).otherwise(F.col("source_anchors"))
    )
    return ways.select(
        F.when(k == 7, F.lit("same")).otherwise(F.concat_ws("-", "id", k.cast("string"))).alias("id"), put(1, "question", F.lit(" ")), put(2, "difficulty", F.lit("odd")),
        "reference_answer", put(3, "source_files", none), anchors.alias("source_anchors"), put(3, "reference_contexts", F.array(F.lit(""))),
    )


_DAMAGED = """WITH w AS (SELECT g.*, k FROM gold_cases g, (SELECT unnest(range(8)) AS k)),
d AS (SELECT CASE WHEN k = 7 THEN 'same' ELSE id || '-' || k END AS id, CASE WHEN k = 1 THEN ' ' ELSE question END AS question,
  CASE WHEN k = 2 THEN 'odd' ELSE difficulty END AS difficulty, reference_answer, CASE WHEN k = 3 THEN [] ELSE source_files END AS source_files,
  CASE WHEN k = 4 THEN list_transform(source_anchors, lambda a: replace(a, ':', ' ')) WHEN k = 5 THEN ['elsewhere.py:1-2'] WHEN k = 6 THEN [source_files[1] || ':9-3']
    ELSE source_anchors END AS source_anchors, CASE WHEN k = 3 THEN [''] ELSE reference_contexts END AS reference_contexts FROM w),
c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM d)"""


@query(_DAMAGED + """ SELECT id, unnest(list_filter([CASE WHEN n > 1 THEN 'id of another case' END, CASE WHEN trim(question) = '' THEN 'no question' END,
CASE WHEN difficulty NOT IN ('simple', 'multi_hop', 'hard') THEN 'unknown difficulty' END, CASE WHEN len(source_files) < 1 THEN 'no source file' END,
CASE WHEN len(source_anchors) < 1 THEN 'no anchor' END, CASE WHEN len(reference_contexts) < 1 THEN 'no context' END,
CASE WHEN len(list_filter(reference_contexts, lambda x: trim(x) = '')) + len(list_filter(source_files, lambda x: trim(x) = '')) > 0 THEN 'empty value' END,
CASE WHEN len(list_filter(source_anchors, lambda a: NOT regexp_full_match(a, '.+:\\d+-\\d+'))) > 0 THEN 'malformed anchor' END,
CASE WHEN len(list_filter(source_anchors, lambda a: regexp_full_match(a, '.+:\\d+-\\d+') AND NOT list_contains(source_files, regexp_extract(a, '^(.+):\\d+-\\d+$', 1)))) > 0 THEN 'anchor of another file' END,
CASE WHEN len(list_filter(source_anchors, lambda a: TRY_CAST(regexp_extract(a, '^.+:(\\d+)-(\\d+)$', 2) AS INT) < TRY_CAST(regexp_extract(a, '^.+:(\\d+)-(\\d+)$', 1) AS INT))) > 0 THEN 'anchor ends before it starts' END],
lambda x: x IS NOT NULL)) AS fault FROM c""")
def gold_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The faults of every case, and of copies that are damaged in each way."""
    return evaluation.faulty_cases(_damaged(table(spark, folder, "gold_cases")), ("simple", "multi_hop", "hard"))


@query("""WITH d AS (SELECT difficulty AS name, count(*) AS n FROM gold_cases GROUP BY 1), f AS (SELECT file AS name, count(*) AS n FROM (SELECT unnest(source_files) AS file FROM gold_cases) GROUP BY 1)
SELECT 'difficulty' AS what, name, n FROM d WHERE n <> CASE name WHEN 'simple' THEN 35 WHEN 'medium' THEN 35 WHEN 'hard' THEN 30 ELSE 0 END
UNION ALL SELECT 'crowded file', name, n FROM f WHERE n > 2 UNION ALL SELECT 'too few files', '', count(*) FROM f HAVING count(*) < 20""")
def gold_distribution(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "gold_cases", "difficulty", "source_files")
    return evaluation.distribution_faults(cases, {"simple": 35, "medium": 35, "hard": 30}, 20, 2)


@query("""WITH k AS (SELECT g.id AS case_id, m.mode, r.run FROM gold_cases g, (SELECT DISTINCT mode FROM answer_records WHERE mode IS NOT NULL) m, (SELECT DISTINCT run FROM answer_records WHERE run IS NOT NULL) r)
SELECT mode, count(*) AS n FROM (SELECT * FROM k EXCEPT SELECT case_id, mode, run FROM answer_records) GROUP BY mode""")
def pending_answers(spark: SparkSession, folder: str) -> DataFrame:
    """How many case, mode and run no record has yet, by mode; modes and runs are a handful."""
    r = table(spark, folder, "answer_records", "case_id", "mode", "run")
    expected = table(spark, folder, "gold_cases", "id").select(F.col("id").alias("case_id"))
    for c in ("mode", "run"):
        expected = expected.crossJoin(F.broadcast(r.select(c).where(F.col(c).isNotNull()).distinct()))
    return evaluation.pending(expected, r, ["case_id", "mode", "run"]).groupBy("mode").agg(F.count("*").alias("n"))


@query("WITH " + _RECORDS + f""", v AS (SELECT mode, {_finite('generation_latency_ms')} AS ms FROM r)
SELECT mode, count(ms) AS n, min(ms) AS least, max(ms) AS most, {_mean_sql('ms')} AS mean FROM v GROUP BY mode""")
def latency_spread(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder, "mode", "generation_latency_ms").select("mode", _measured("generation_latency_ms").alias("ms"))
    return r.groupBy("mode").agg(F.count("ms").alias("n"), F.min("ms").alias("least"), F.max("ms").alias("most"), _mean("ms").alias("mean"))


@query("WITH " + _RECORDS + f""", v AS (SELECT mode, round({_finite('retrieval_latency_ms')}) AS ms FROM r), k AS (SELECT mode, ms, row_number() OVER (PARTITION BY mode ORDER BY ms) AS rn, count(*) OVER (PARTITION BY mode) AS n FROM v WHERE ms IS NOT NULL)
SELECT mode, p, ms AS value FROM k, (SELECT unnest([0.5::DOUBLE, 0.95]) AS p) WHERE rn = greatest(1, CAST(floor(p * n) AS BIGINT))""")
def latency_nearest_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of whole milliseconds."""
    r = _records(spark, folder, "mode", "retrieval_latency_ms").select("mode", F.round(_measured("retrieval_latency_ms")).alias("ms"))
    return evaluation.nearest_ranks(r, "mode", "ms", [0.5, 0.95])


@query("WITH " + VIEWS + """, c AS (SELECT repository AS qid, id AS item, row_number() OVER (PARTITION BY repository ORDER BY id) AS rank FROM n WHERE label = 'Class' AND repository IS NOT NULL),
a AS (SELECT qid, item, 1.0::DOUBLE / rank AS score, rank FROM c WHERE rank <= 6),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY rel, other) AS pos FROM (SELECT src_id AS id, rel, dst_id AS other, 'out' AS direction FROM e UNION ALL SELECT dst_id, rel, src_id, 'in' FROM e)) WHERE pos <= 10),
m AS (SELECT qid, item, score, '' AS rel, 0 AS part, rank, '' AS direction, 0 AS k FROM a UNION ALL SELECT qid, other, score * 0.9, s.rel, 1, rank, direction, pos FROM a JOIN s ON s.id = a.item),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, item ORDER BY part, rank, direction, k) AS rn FROM m)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, part, rank, direction, k, item) AS pos, item, score, rel FROM f WHERE rn = 1""")
def expanded_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The first classes of each repository as anchors, with their neighbours."""
    n, e = graph(spark, folder)
    c = n.where("label = 'Class' AND repository IS NOT NULL").select(F.col("repository").alias("qid"), F.col("id").alias("item"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("item"))).where("rank <= 6")
    return expanded(c.withColumn("score", 1.0 / F.col("rank")), e)


@query("WITH " + _RECORDS + """, x AS (SELECT case_id AS qid, record_id AS list, unnest(retrieved_files) AS item, generate_subscripts(retrieved_files, 1) AS rank, coalesce(mode, '') AS source FROM r WHERE case_id IS NOT NULL),
k AS (SELECT qid, list, item, min(rank) AS rank, any_value(source) AS source FROM x WHERE item <> '' GROUP BY 1, 2, 3)
SELECT qid, item, CAST(sum(CAST(round(1.0 / (60 + rank) * 1e9) AS BIGINT)) AS BIGINT) / 1e9 AS score, CASE WHEN count(DISTINCT source) FILTER (WHERE source <> '') > 1 THEN 'hybrid' ELSE max(source) FILTER (WHERE source <> '') END AS source,
min_by(list_last(string_split(item, '/')), (list, rank)) AS name FROM k GROUP BY 1, 2""")
def fused_records(spark: SparkSession, folder: str) -> DataFrame:
    """The files that all records of a case retrieved, fused as whole rows."""
    r = _records(spark, folder, "case_id", "mode", "retrieved_files").where("case_id IS NOT NULL")
    x = r.select(F.col("case_id").alias("qid"), F.col("record_id").alias("list"), F.coalesce("mode", F.lit("")).alias("source"), F.posexplode("retrieved_files").alias("rank", "item"))
    return fuse_rows(x.select("qid", "list", "source", "item", (F.col("rank") + 1).alias("rank"), F.substring_index("item", "/", -1).alias("name")), F.lit(1.0))


@query("WITH " + VIEWS + """ SELECT 'repoqa-' || id AS qid, name AS target_function, file_path, CASE WHEN length(q) > 200 THEN q[1:197] || '...' ELSE q END AS question
FROM (SELECT *, trim(string_split(trim(docstring, chr(10) || ' '), chr(10))[1]) AS q FROM n WHERE label = 'Function' AND length(docstring) > 40 AND name <> '' AND file_path <> '') ORDER BY md5(id), id LIMIT 50""")
def repoqa_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty documented functions, drawn by a hash of their ids, each with the first line of its docstring as question."""
    n = graph(spark, folder)[0].where("label = 'Function' AND length(docstring) > 40 AND name <> '' AND file_path <> ''")
    q = F.trim(F.get(F.split(F.expr("trim(BOTH '\n ' FROM docstring)"), "\n"), F.lit(0)))
    drawn = n.orderBy(F.md5("id"), "id").limit(50)
    return drawn.select(F.concat(F.lit("repoqa-"), "id").alias("qid"), F.col("name").alias("target_function"), "file_path", q.alias("q")).select(
        "qid", "target_function", "file_path", F.when(F.length("q") > 200, F.concat(F.substring("q", 1, 197), F.lit("..."))).otherwise(F.col("q")).alias("question")
    )


@query()
def repoqa_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Where hybrid and vector retrieval find the drawn functions: qid, mode, rank."""
    cases, (n, e) = repoqa_sample(spark, folder), graph(spark, folder)
    names = n.select(F.col("id").alias("n_id"), "name", "file_path")
    ranks = []
    for mode, alone in (("hybrid", False), ("vector", True)):
        found = retrieve(cases.select("qid", "question"), n, e, 10, skip_graph=alone).join(names, F.col("item") == F.col("n_id"), "left")
        ranks.append(target_ranks(found, cases).select("qid", F.lit(mode).alias("mode"), "rank"))
    return ranks[0].unionByName(ranks[1])


@query()
def retrieved_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The packed context of every question that was asked."""
    asked = table(spark, folder, "gold_cases", "id", "question").where("question <> ''").select(F.col("id").alias("qid"), "question")
    n, e = graph(spark, folder)
    return contexts(asked, n, e)


_PATH = r"regexp_replace(regexp_replace(lower(replace(file_path, '\', '/')), '^(?:\./|/)+(?:src/)?|^src/', ''), '/(?:\./|/)+', '/', 'g')"


@query(f"""WITH c AS (SELECT DISTINCT repository, {_PATH} AS path, start_line AS a, end_line AS b FROM chunks),
f AS (SELECT repository, {_PATH} AS path, max_by(content, (loaded_at, file_id)) AS content FROM source_files WHERE content IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM f)
SELECT c.repository, c.path || ':' || a || '-' || b AS anchor,
CASE WHEN a >= 1 AND b >= a AND b <= len(lines) THEN array_to_string(lines[a:b], chr(10)) END AS excerpt
FROM c LEFT JOIN l ON l.path = c.path AND l.repository IS NOT DISTINCT FROM c.repository""")
def chunk_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every chunk read again from the last loaded row of its file: repository, anchor, excerpt."""
    anchor = F.format_string("%s:%d-%d", normal_path(F.col("file_path")), "start_line", "end_line")
    c = table(spark, folder, "chunks", "repository", "file_path", "start_line", "end_line").select("repository", anchor.alias("anchor")).distinct()
    files = table(spark, folder, "source_files", "file_id", "repository", "file_path", "content", "loaded_at").where("content IS NOT NULL")
    last = F.max_by("content", F.struct("loaded_at", "file_id"))
    files = files.groupBy("repository", normal_path(F.col("file_path")).alias("file_path")).agg(last.alias("content"))
    return anchor_excerpts(c, files)
