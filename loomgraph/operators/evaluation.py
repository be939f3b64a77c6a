"""Evaluation cases and runs: faults of cases and data sets, reviews, distribution, pending work, latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANCHOR = r"^(.+):(\d+)-(\d+)$"
NUMBERED = r"(?i)\bcomponent\s*#?\d+\b"
GENERIC = r"(?i)\b(?:the\s+)?(?:component|module)\s+(?:works?|do|does|behaves?|operates?|functions?|handles?|returns?)\b"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _named(faults: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in faults.items())), lambda x: x.isNotNull())


def faulty_cases(cases: DataFrame, difficulties: tuple[str, ...] = ("simple", "medium", "hard")) -> DataFrame:
    """(id, fault) for every rule of a sound case that one breaks: its id is given and its own, its texts are, its difficulty is
    known, its lists are not empty and hold no empty value, its anchors are well-formed and of its own files."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    hollow = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    anchors = F.coalesce("source_anchors", F.array().cast("array<string>"))
    part = lambda a, k: F.regexp_extract(a, ANCHOR, k)
    files = F.coalesce("source_files", F.array().cast("array<string>"))
    faults = {
        "no id": _blank("id"), "id of another case": F.col("n_cases") > 1, "no question": _blank("question"), "no answer": _blank("reference_answer"),
        "unknown difficulty": ~F.coalesce(F.col("difficulty").isin(*difficulties), F.lit(False)),
        "no source file": empty("source_files"), "no anchor": empty("source_anchors"), "no context": empty("reference_contexts"),
        "empty value": hollow("source_files") | hollow("source_anchors") | hollow("reference_contexts"),
        "malformed anchor": F.exists(anchors, lambda a: ~a.rlike(ANCHOR)),
        "anchor of another file": F.exists(anchors, lambda a: a.rlike(ANCHOR) & ~F.array_contains(files, part(a, 1))),
        "anchor ends before it starts": F.exists(anchors, lambda a: part(a, 3).try_cast("int") < part(a, 2).try_cast("int")),
    }
    counts = cases.groupBy(F.col("id").alias("c_id")).agg(F.count("*").alias("n_cases"))
    return cases.join(counts, F.col("id").eqNullSafe(F.col("c_id"))).select("id", F.explode(_named(faults)).alias("fault"))


def faulty_datasets(data: DataFrame, allow_draft: bool = False) -> DataFrame:
    """(name, fault) for every rule that a data set (see ``sources.files.GOLD``) breaks."""
    source = [F.coalesce(F.trim(F.col(f"source.{c}")), F.lit("")) for c in ("package", "version", "artifact_sha256")]
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    status, some = given("review.status"), reduce(lambda a, b: a | b, [c != "" for c in source])
    every = reduce(lambda a, b: a & b, [c != "" for c in source])
    faults = {
        "unknown schema version": F.coalesce(F.col("schema_version") != 1, F.lit(True)),
        "identity may change": ~F.coalesce(F.trim("source_identity").rlike("^(?:sha256|git):"), F.lit(False)),
        "source incomplete": some & ~every,
        "malformed digest": (source[2] != "") & ~source[2].rlike("^[0-9a-f]{64}$"),
        "unknown review status": ~status.isin("draft", "approved"),
        "review not attributable": (status == "approved") & ((given("review.reviewer") == "") | ~given("review.reviewer_type").isin("human", "ai_source_review") | (given("review.reviewed_at") == "")),
        "still a draft": (status != "approved") & F.lit(not allow_draft),
        "no case": F.coalesce(F.size("cases"), F.lit(0)) < 1,
    }
    return data.select("name", F.explode(_named(faults)).alias("fault"))


def review_faults(reviews: DataFrame, source_validated: bool) -> DataFrame:
    """(name, fault) of reviews (name, status, reviewer, reviewer_type, reviewed_at, evidence_grade): approved ones name who and when,
    and their grade is that of the kind of reviewer; reviews against the source need a validated source."""
    given = lambda c: F.coalesce(F.trim(c), F.lit(""))
    grade = F.when(given("reviewer_type") == "human", "approved_human_review").when(given("reviewer_type") == "ai_source_review", "approved_ai_source_review")
    faults = {
        "not attributable": (given("status") != "approved") | (given("reviewer") == "") | (given("reviewed_at") == ""),
        "wrong grade": ~F.coalesce(given("evidence_grade") == grade, F.lit(False)),
        "source not validated": (given("reviewer_type") == "ai_source_review") & F.lit(not source_validated),
    }
    return reviews.select("name", F.explode(_named(faults)).alias("fault"))


def distribution_faults(cases: DataFrame, shares: dict[str, int], least_files: int, most_cases: int) -> DataFrame:
    """(what, name, n) of what a case set has too many or too few of: difficulties against ``shares``, cases of a file, files."""
    by = cases.groupBy(F.col("difficulty").alias("name")).agg(F.count("*").alias("n"))
    wanted = F.coalesce(*[F.when(F.col("name") == k, n) for k, n in shares.items()], F.lit(0))
    per_file = cases.select(F.explode("source_files").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    files = per_file.agg(F.count("*").alias("n")).select(F.lit("too few files").alias("what"), F.lit("").alias("name"), "n")
    return (
        by.where(F.col("n") != wanted).select(F.lit("difficulty").alias("what"), "name", "n")
        .unionByName(per_file.where(F.col("n") > most_cases).select(F.lit("crowded file").alias("what"), "name", "n"))
        .unionByName(files.where(F.col("n") < least_files))
    )


def template_questions(cases: DataFrame) -> DataFrame:
    """(id, fault) of questions that are a numbered or generic template, or another case's question but for numbers and blanks."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("question", NUMBERED, "component #N")), r"\b\d+\b", "N"), r"\s+", " "))
    c = cases.select("id", "question", norm.alias("norm"))
    n = c.groupBy(F.col("norm").alias("n_norm")).agg(F.count("*").alias("n"))
    faults = {"numbered": F.col("question").rlike(NUMBERED), "generic": F.col("question").rlike(GENERIC), "repeated": F.col("n") > 1}
    return c.join(n, F.col("norm") == F.col("n_norm")).select("id", F.explode(_named(faults)).alias("fault"))


def lost_prefix(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, pos, was, now) where an ordered list (id, items) does not begin with what it was: the places that differ or are gone."""
    o = old.select("id", F.posexplode("items").alias("pos", "was"))
    n = new.select(F.col("id").alias("n_id"), F.posexplode("items").alias("n_pos", "now"))
    both = o.join(n, (F.col("id") == F.col("n_id")) & (F.col("pos") == F.col("n_pos")), "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("id", "pos", "was", "now")


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``expected`` that ``done`` has not: what is left to do when a run is taken up again."""
    return expected.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def unexpected(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fault) that forbid taking a run up again: keys that no one expects, or that are there twice."""
    counts = done.groupBy(*keys).agg(F.count("*").alias("n"))
    foreign = counts.join(expected.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("unexpected").alias("fault"))
    return foreign.unionByName(counts.where("n > 1").select(*keys, F.lit("repeated").alias("fault")))


def nearest_ranks(df: DataFrame, group: str, value: str, ps: list[float]) -> DataFrame:
    """group, p, value: the value at place max(1, floor(p n)) of each group, in order. Groups are counted by value first; running
    sums are over the different values, which ``df`` has rounded to as many as are wanted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("v"))
    placed = counts.withColumn("end", upto)
    totals = counts.groupBy(F.col("g").alias("t")).agg(F.sum("n").alias("all")).select("t", "all", F.explode(F.lit(ps)).alias("p"))
    place = F.greatest(F.lit(1), F.floor(F.col("p") * F.col("all")))
    hit = placed.join(totals, F.col("g").eqNullSafe(F.col("t"))).where((place <= F.col("end")) & (place > F.col("end") - F.col("n")))
    return hit.select(F.col("g").alias(group), "p", F.col("v").alias("value"))
