"""Sources other than tables: source trees, JSON case files and lists of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the analysed system, in their order.
EXCLUDED = [
    ".venv", "venv", "fixtures", "experiments", "dist", "build", ".git", "__pycache__", "node_modules", ".agents", ".pytest_cache",
    ".ruff_cache", ".roo", ".clinerules",
]

REPOQA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "question", "target_function", "file_path", "notes")])
GOLD_CASE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "difficulty", "question", "reference_answer")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("source_files", "source_anchors", "reference_contexts")]
)
GOLD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("source_identity", T.StringType()),
        T.StructField("source", T.StructType([T.StructField(c, T.StringType()) for c in ("package", "version", "artifact_sha256")])),
        T.StructField("review", T.StructType([T.StructField(c, T.StringType()) for c in ("status", "reviewer", "reviewer_type", "reviewed_at")])),
        T.StructField("cases", T.ArrayType(GOLD_CASE)),
    ]
)


def wanted(path: Column, excluded: list[str] | None = None) -> Column:
    """Whether no folder of a relative path is excluded or a virtual environment, and its kind of file is known."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda p: p.isin(excluded or EXCLUDED) | p.startswith(".venv"))
    name = F.lower(F.element_at(parts, -1))
    known = name.rlike(r"\.(?:py|md|ya?ml)$") | (name == "dockerfile")
    return ~bad & known


def source_tree(spark: SparkSession, root: str, repository: str, excluded: list[str] | None = None) -> DataFrame:
    """Files of a checked-out repository: repository, file_path, content, digest. Undecodable bytes become replacement characters."""
    base = root.removeprefix("file:").rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(base) + 2})")
    out = files.select(path.alias("file_path"), "content").where(wanted(F.col("file_path"), excluded))
    return out.select(F.lit(repository).alias("repository"), "file_path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("digest"))


def repoqa_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPOQA).option("multiLine", True).json(path)


def gold_datasets(spark: SparkSession, path: str) -> DataFrame:
    """One row per data set, as it stands in its file."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path)


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case with the data set's name, identity and review status."""
    data = gold_datasets(spark, path)
    return data.select("name", "schema_version", "source_identity", F.col("review.status").alias("review"), F.explode("cases").alias("c")).select("name", "schema_version", "source_identity", "review", "c.*")


def changes(lines: DataFrame, column: str = "line") -> DataFrame:
    """(file_path, change) of status lines: 'deleted' for D and a rename's old name, else 'modified'; unwanted files left out."""
    row = F.split(F.regexp_replace(F.trim(column), r"^\?\?\s+", "A\t"), r"\t+")
    kind = F.upper(F.substring(F.trim(row[0]), 1, 1))
    pair = lambda p, c: F.struct(p.alias("file_path"), F.lit(c).alias("change"))
    both = F.array(pair(row[1], "deleted"), pair(F.get(row, F.lit(2)), "modified"))
    one = F.when(kind == "D", F.array(pair(row[1], "deleted"))).otherwise(F.array(pair(row[1], "modified")))
    found = lines.where(F.size(row) >= 2).select(F.inline(F.when((kind == "R") & (F.size(row) >= 3), both).otherwise(one)))
    return found.where(F.col("file_path").isNotNull() & wanted(F.col("file_path"))).distinct()


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository, file_path, change) between two snapshots by content digest: 'added', 'modified' or 'deleted'."""
    keys = ["repository", "file_path"]
    o, n = (d.select(*keys, F.col("digest").alias(c)).distinct() for d, c in ((old, "was"), (new, "now")))
    both = o.join(n, keys, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def normal_path(path: Column) -> Column:
    """A path as one would compare it: forward slashes, no leading './', '/' or 'src/', lower case."""
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(?:\./|/)+(?:src/)?|^src/|(?<=/)(?:\./|/)+", "")


def anchor_excerpts(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Text of anchors 'file:first-last' (column ``anchor``): anchor, excerpt; null where the lines are not in the file.

    Where the anchors have a ``repository``, so do the files and the result, and paths are compared whatever their spelling.
    """
    pattern = r"^(.+):(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract("anchor", pattern, k)
    a = anchors.where(F.col("anchor").rlike(pattern)).select(*(c for c in anchors.columns if c in ("repository", "anchor")), part(1).alias("path"), part(2).cast("int").alias("first"), part(3).cast("int").alias("last"))
    lines = F.split("content", r"\r\n|\r|\n")
    inside = (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size(lines))
    text = F.array_join(F.slice(lines, F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    if "repository" in anchors.columns:
        f = files.select(F.col("repository").alias("f_repository"), normal_path(F.col("file_path")).alias("f_path"), "content")
        on = (normal_path(F.col("path")) == F.col("f_path")) & F.col("repository").eqNullSafe(F.col("f_repository"))
        return a.join(f, on, "left").select("repository", "anchor", F.when(inside, text).alias("excerpt"))
    joined = a.join(files.select("file_path", "content"), a["path"] == F.col("file_path"), "left")
    return joined.select("anchor", F.when(inside, text).alias("excerpt"))
