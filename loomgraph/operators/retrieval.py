"""Hybrid retrieval for many questions at once: graph and vector lists, fused, demoted and packed, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import entities, target_label, token_estimate
from loomgraph.operators.ranking import fuse, top
from loomgraph.operators.traversal import called_siblings, first_neighbours, neighbours
from loomgraph.operators.vectors import cosine_top_k

DIM = 64


def hashed_vector(text: Column, dim: int = DIM) -> Column:
    """Counts of hashed words: a deterministic stand-in for an embedding model; replace it to use another."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|_", " ")), F.lit(r"\p{L}{2,}"), 0)
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))

    @F.pandas_udf("array<double>")
    def counted(batch: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(b, minlength=dim).astype("float64") for b in batch])

    return counted(buckets)


def graph_list(questions: DataFrame, nodes: DataFrame, links: DataFrame, seeds: int = 10, around: int = 30) -> DataFrame:
    """(qid, item, rank): nodes named in a question, at most ``seeds``, after up to ``around`` neighbours of each."""
    terms = questions.select("qid", F.posexplode(entities(F.col("question"))).alias("at", "term"))
    named = nodes.select("id", "name").where(F.col("name") != "")
    hit = terms.join(named, F.col("term") == F.col("name")).groupBy("qid", "id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("qid").orderBy("at", F.length("id"), "id")
    seed = hit.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= seeds)
    near = neighbours(links, "both").join(seed.select("id").distinct(), "id", "left_semi")
    near = first_neighbours(near, around).select(F.col("id").alias("seed"), "other", F.col("pos").alias("n"))
    rows = seed.join(near, F.col("id") == F.col("seed")).select("qid", F.col("other").alias("item"), F.lit(0).alias("part"), "pos", "n")
    rows = rows.unionByName(seed.select("qid", F.col("id").alias("item"), F.lit(1).alias("part"), "pos", F.lit(0).alias("n")))
    first = rows.groupBy("qid", "item").agg(F.min(F.struct("part", "pos", "n")).alias("k"))
    return first.select("qid", "item", F.row_number().over(Window.partitionBy("qid").orderBy("k", "item")).alias("rank"))


def vector_list(questions: DataFrame, nodes: DataFrame, k: int = 20, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """(qid, item, rank): the ``k`` nodes whose text is most similar, as ``embed`` makes vectors of ``DIM`` numbers of it."""
    text = F.concat_ws(" ", "name", "docstring")
    embedded = nodes.where("coalesce(type, '') <> 'external'").select("id", embed(text).alias("embedding"))
    asked = questions.select(F.col("qid").alias("id"), embed(F.col("question")).alias("embedding"))
    found = cosine_top_k(embedded, asked, k, DIM, key="id")
    return found.select(F.col("query_id").alias("qid"), F.col("id").alias("item"), F.col("pos").alias("rank"))


def retrieve(
    questions: DataFrame, nodes: DataFrame, links: DataFrame, k: int = 20, graph_weight: float = 1.5, skip_graph: bool = False,
    embed: Callable[[Column], Column] = hashed_vector,
) -> DataFrame:
    """(qid, pos, item, score): reciprocal rank fusion of both lists; placeholders of unresolved calls come after all others.

    ``skip_graph`` gives the vector list alone.
    """
    vectors = vector_list(questions, nodes, 2 * k, embed).withColumn("w", F.lit(1.0))
    lists = vectors if skip_graph else graph_list(questions, nodes, links).withColumn("w", F.lit(graph_weight)).unionByName(vectors)
    best = top(fuse(lists, ["qid"], F.col("w")), ["qid"], 2 * k)
    order = Window.partitionBy("qid").orderBy(F.col("item").startswith("__call__"), "pos")
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("qid", "pos", "item", "score")


FIELDS = ["text", "rel", "name", "label", "file_path", "repository"]


def fuse_rows(rows: DataFrame, weight: Column, k: int = 60) -> DataFrame:
    """Fuses ranked rows (qid, list, rank, item, source and any of ``FIELDS``): qid, item, score, source and the fields.

    Of each field the first that is not empty counts, by list and rank; the source is 'hybrid' where sources differ. An item
    that a list has twice scores by its first rank.
    """
    fields = [c for c in FIELDS if c in rows.columns]
    by = Window.partitionBy("qid", "list", "item").orderBy("rank")
    one = rows.where(F.col("item") != "").withColumn("_n", F.row_number().over(by)).where("_n = 1")
    order = F.struct("list", "rank")
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", order)).alias(c)
    sources = F.array_distinct(F.filter(F.collect_list("source"), lambda x: x != ""))
    part = F.round(weight / (F.lit(k) + F.col("rank")) * 1e9).cast("bigint")
    out = one.groupBy("qid", "item").agg((F.sum(part) / 1e9).alias("score"), sources.alias("_sources"), *map(first, fields))
    return out.withColumn("source", F.when(F.size("_sources") > 1, "hybrid").otherwise(F.get("_sources", F.lit(0)))).drop("_sources")


def promoted(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (qid, pos, item, label) with new places: those of the wanted label (``wanted``: qid, target_label) first, if there are
    any, placeholders of unresolved calls last; else as they stood."""
    stub = F.col("item").startswith("__call__")
    asked = F.lit(False)
    if wanted is not None:
        rows = rows.join(wanted.select(F.col("qid").alias("_qid"), "target_label"), F.col("qid") == F.col("_qid"), "left").drop("_qid")
        asked = F.coalesce(F.col("label") == F.col("target_label"), F.lit(False))
    order = Window.partitionBy("qid").orderBy(stub, ~asked, "pos")
    return rows.withColumn("pos", F.row_number().over(order)).drop("target_label")


def expanded(anchors: DataFrame, links: DataFrame, n_anchors: int = 6, around: int = 10, decay: float = 0.9) -> DataFrame:
    """(qid, pos, item, score, rel): the first anchors of each question (qid, item, score, rank) and their neighbours, up to
    ``around`` on either side, at ``decay`` times the anchor's score. What is met twice counts where it was met first."""
    chosen = anchors.where(F.col("rank") <= n_anchors).select("qid", "item", "score", "rank")
    ids = chosen.select(F.col("item").alias("id")).distinct()
    near = [first_neighbours(neighbours(links, d).join(ids, "id", "left_semi"), around) for d in ("in", "out")]
    sides = near[0].unionByName(near[1]).select(F.col("id").alias("a_id"), "rel", "other", "pos", "direction")
    met = chosen.join(sides, F.col("item") == F.col("a_id")).select(
        "qid", F.col("other").alias("item"), (F.col("score") * decay).alias("score"), "rel", F.lit(1).alias("part"), "rank", "direction", F.col("pos").alias("n")
    )
    own = chosen.select("qid", "item", "score", F.lit("").alias("rel"), F.lit(0).alias("part"), "rank", F.lit("").alias("direction"), F.lit(0).alias("n"))
    seen = own.unionByName(met).groupBy("qid", "item").agg(F.min(F.struct("part", "rank", "direction", "n", "score", "rel")).alias("f"))
    order = Window.partitionBy("qid").orderBy(F.desc("f.score"), "f.part", "f.rank", "f.direction", "f.n", "item")
    return seen.select("qid", F.row_number().over(order).alias("pos"), "item", "f.score", "f.rel")


def packed(rows: DataFrame, budget: int = 2048, tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """qid, context, included, excluded, tokens: blocks of the ranked rows (qid, question, pos, item, score, source and ``FIELDS``)
    as far as they fit the budget of tokens; a block that does not is skipped and smaller ones follow. A file gives one block.

    The rows of a question are its top results, so the list that is folded is short.
    """
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("[Structural node — no text chunk indexed]"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("item"))
    head = F.concat_ws(
        " ", F.format_string("[%d]", "pos"), F.when(F.col("label") != "", F.concat_ws(": ", "label", name)).otherwise(name),
        F.when(F.col("file_path") != "", F.concat(F.lit("("), "file_path", F.lit(")"))), F.when(F.col("rel") != "", F.concat(F.lit("via "), "rel")),
        F.format_string("[score=%.4f, src=%s]", "score", F.coalesce("source", F.lit(""))),
    )
    block = F.concat(head, F.lit("\n"), text, F.lit("\n"))
    once = F.row_number().over(Window.partitionBy("qid", "repository", "file_path").orderBy("pos"))
    named = (F.col("file_path") != "") & (F.col("repository") != "")
    kept = rows.withColumn("_n", once).where(F.coalesce(~named, F.lit(True)) | (F.col("_n") == 1))
    lists = kept.groupBy("qid", "question").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block"), tokens(block).cast("int").alias("size")))).alias("blocks"))
    title = F.concat(F.lit("Query: "), F.col("question"), F.lit("\n"))
    start = F.struct(tokens(title).cast("int").alias("used"), F.array(title).alias("kept"))

    def step(acc: Column, b: Column) -> Column:
        fits = acc["used"] + b["size"] <= budget
        return F.struct((acc["used"] + F.when(fits, b["size"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(acc["kept"], b["block"])).otherwise(acc["kept"]).alias("kept"))

    out = lists.withColumn("p", F.aggregate("blocks", start, step))
    context = F.rtrim(F.array_join("p.kept", "\n"))
    return out.select("qid", context.alias("context"), (F.size("p.kept") - 1).alias("included"), (F.size("blocks") - F.size("p.kept") + 1).alias("excluded"), tokens(context).cast("int").alias("tokens"))


def contexts(questions: DataFrame, nodes: DataFrame, links: DataFrame, k: int = 20, budget: int = 2048, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """The packed context of every question (qid, question): retrieved nodes, functions with the names of the siblings they call."""
    found = retrieve(questions, nodes, links, k, embed=embed)
    n = nodes.select(F.col("id").alias("n_id"), "name", "label", "file_path", "repository", F.coalesce("docstring", F.lit("")).alias("docstring"))
    s = called_siblings(links, nodes).select(F.col("id").alias("s_id"), "siblings")
    rows = found.join(n, F.col("item") == F.col("n_id"), "left").join(s, F.col("item") == F.col("s_id"), "left")
    rows = promoted(rows, questions.select("qid", target_label(F.col("question")).alias("target_label")))
    text = F.concat_ws("\n", F.nullif("docstring", F.lit("")), F.concat(F.lit("calls: "), F.col("siblings")))
    rows = rows.select("qid", "pos", "item", "score", "name", "label", "file_path", "repository", F.lit("").alias("rel"), F.lit("hybrid").alias("source"), text.alias("text"))
    return packed(rows.join(questions.select("qid", "question"), "qid"), budget)


def target_ranks(found: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, rank): where the results (qid, pos, item, name, file_path) first have the case's function (qid, target_function,
    file_path): in a file whose last two path parts (or the last, if one has no more) are the case's, under its name or with it as
    a part of the id. Null where they do not."""
    tail = lambda c, n: F.array_join(F.slice(F.reverse(F.filter(F.split(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), "/"), lambda x: x != "")), 1, n), "/")
    t = cases.select(F.col("qid").alias("t_qid"), F.lower("target_function").alias("fn"), F.col("file_path").alias("t_path"))
    rows = t.join(found, F.col("qid") == F.col("t_qid"), "left")
    deep = F.col("file_path").rlike(r"[^/\\][/\\]+[^/\\]") & F.col("t_path").rlike(r"[^/\\][/\\]+[^/\\]")
    file = F.when(deep, tail(F.col("file_path"), 2) == tail(F.col("t_path"), 2)).otherwise(tail(F.col("file_path"), 1) == tail(F.col("t_path"), 1))
    item = F.lower("item")
    named = (F.lower("name") == F.col("fn")) | F.array_contains(F.split(item, r"::|\."), F.col("fn"))
    return rows.groupBy(F.col("t_qid").alias("qid")).agg(F.min(F.when(file & named & (F.col("file_path") != ""), F.col("pos"))).alias("rank"))
