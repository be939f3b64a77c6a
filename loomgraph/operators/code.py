"""Python sources to graph rows and to overlapping line windows. Sequential work, so Arrow-backed functions."""

from __future__ import annotations

import ast
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.spreading import spread
from loomgraph.functions.text import chunk_header, path_fqn

ROWS = (
    "kind string, label string, id string, name string, rel string, other string, line int, properties map<string, string>, "
    "repository string, file_path string"
)
_ABSTRACT = {"ABC", "ABCMeta"}


def _text(value: object) -> str:
    return {True: "true", False: "false", None: ""}.get(value, str(value)) if value is None or isinstance(value, bool) else str(value)


def _walk(module: str, path: str, statements: list[ast.stmt], n_lines: int) -> Iterator[tuple]:
    """('node', label, id, name, '', '', line, properties) and ('edge', '', src, '', rel, dst, line, properties) rows of a module.

    Names that are defined elsewhere are nodes of type 'external': modules as they are imported, bases by their last part and
    called functions as ``__call__`` and their name.
    """

    def node(label: str, me: str, name: str, at: int, /, **properties: object) -> tuple:
        return ("node", label, me, name, "", "", at, {"name": name} | {k: _text(v) for k, v in properties.items()})

    def edge(src: str, rel: str, dst: str, at: int, /, **properties: object) -> tuple:
        return ("edge", "", src, "", rel, dst, at, {k: _text(v) for k, v in properties.items()})

    def outside(label: str, name: str) -> tuple:
        return node(label, name, name.removeprefix("__call__"), 0, file_path="", language="python", type="external", line_count=0)

    def dotted(x: ast.expr) -> str:
        return ast.unparse(x) if isinstance(x, (ast.Name, ast.Attribute)) else ""

    def span(s: ast.stmt) -> dict[str, object]:
        first = min([s.lineno, *(d.lineno for d in s.decorator_list)])
        return {"line_start": first, "line_end": s.end_lineno, "docstring": (ast.get_docstring(s, clean=False) or "").strip()}

    def marks(s: ast.stmt) -> list[str]:
        return [ast.unparse(d) for d in s.decorator_list]

    def function(owner: str, s: ast.FunctionDef | ast.AsyncFunctionDef, class_name: str | None) -> Iterator[tuple]:
        me, at = f"{owner}.{s.name}", span(s)
        yield node(
            "Function", me, s.name, s.lineno, file_path=path, class_name=class_name, signature=f"def {s.name}({ast.unparse(s.args)})",
            is_async=isinstance(s, ast.AsyncFunctionDef), is_abstract=any("abstractmethod" in d for d in marks(s)),
            is_property=any("property" in d for d in marks(s)), **at,
        )
        yield edge(owner, "DEFINES", me, s.lineno)
        yield edge(me, "DEFINED_IN", module, s.lineno)
        for stmt in s.body:
            for x in ast.walk(stmt):
                if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
                    last = x.func.attr if isinstance(x.func, ast.Attribute) else x.func.id
                    yield outside("Function", f"__call__{last}")
                    yield edge(me, "CALLS", f"__call__{last}", x.lineno, line=x.lineno, callee_expr=ast.unparse(x.func))

    def klass(s: ast.ClassDef) -> Iterator[tuple]:
        me = f"{module}.{s.name}"
        methods = [m for m in s.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        bases = [x for b in s.bases if (x := dotted(b.value if isinstance(b, ast.Subscript) else b))]
        named = {b.split(".")[-1] for b in [*bases, *(dotted(k.value) for k in s.keywords)]}
        abstract = bool(named & _ABSTRACT) or any("abstractmethod" in d for m in methods for d in marks(m))
        yield node("Class", me, s.name, s.lineno, file_path=path, is_abstract=abstract, **span(s))
        yield edge(module, "DEFINES", me, s.lineno)
        yield edge(me, "DEFINED_IN", module, s.lineno)
        for order, base in enumerate(bases, 1):
            yield outside("Class", base.split(".")[-1])
            yield edge(me, "INHERITS", base.split(".")[-1], s.lineno, order=order)
        for m in methods:
            yield from function(me, m, s.name)

    kind = "init" if path.endswith("__init__.py") else "test" if "/test" in path or path.startswith("test") else "source"
    yield node("Module", module, module.rpartition("::")[2].rpartition(".")[2], 1, file_path=path, language="python", type=kind, line_count=n_lines)
    for s in statements:
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            is_from = isinstance(s, ast.ImportFrom)
            for name in [s.module] if is_from else [x.name for x in s.names]:
                if name and name != "__future__":
                    yield outside("Module", name)
                    yield edge(module, "IMPORTS", name, s.lineno, is_from=is_from)
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from function(module, s, None)
        elif isinstance(s, ast.ClassDef):
            yield from klass(s)


def _statements(text: str) -> tuple[list[ast.stmt], bool]:
    """The statements of a file, and whether it parses; of one that does not, the top-level blocks that do by themselves."""
    try:
        return ast.parse(text).body, True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    lines = text.splitlines()
    starts = [i for i, x in enumerate(lines) if x[:1].strip() and x[0] not in "#)]}" and not (i and lines[i - 1].startswith("@"))]
    kept = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        try:
            block = ast.parse("\n".join(lines[a:b])).body
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        kept += [ast.increment_lineno(s, a) for s in block]
    return kept, False


def extract(files: DataFrame) -> DataFrame:
    """Nodes and edges of every Python file as one tagged table; a file that does not parse also gives a row of kind 'error' and
    keeps the top-level statements that are sound. Files of other languages give an error row alone.

    ``files`` has repository, file_path and content; null contents have no row. Repeated rows count once. Signatures are as
    Python writes them, without the return type.
    """
    p = F.replace("file_path", F.lit("\\"), F.lit("/"))
    source = files.where(F.col("content").isNotNull() & F.lower("file_path").rlike(r"\.(?:py|java)$")).select(
        "repository", "file_path", F.concat_ws("::", "repository", path_fqn(F.regexp_replace(p, r"(?i)\.py$", ".py"))).alias("module"), "content"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for batch in batches:
            rows = []
            for repo, path, module, text in zip(batch["repository"], batch["file_path"], batch["module"], batch["content"], strict=True):
                if path.lower().endswith(".java"):
                    rows.append(("error", "", module, "unsupported language", "", "", None, {}, repo, path))
                    continue
                body, sound = _statements(text)
                rows += [(*r, repo, path) for r in _walk(module, path.replace("\\", "/"), body, text.count("\n") + 1)]
                if not sound:
                    rows.append(("error", "", module, "syntax error", "", "", None, {}, repo, path))
            out = pd.DataFrame(rows, columns=["kind", "label", "id", "name", "rel", "other", "line", "properties", "repository", "file_path"])
            yield out.astype({"line": "Int32"})

    columns = [c.strip().split(" ")[0] for c in ROWS.replace("map<string, string>", "map").split(",")]
    tagged = spread(source).mapInPandas(run, ROWS)
    # of repeated rows one is kept; maps do not compare, their JSON does
    return tagged.withColumn("_p", F.to_json("properties")).dropDuplicates([*(c for c in columns if c != "properties"), "_p"]).drop("_p")


def non_code(files: DataFrame) -> DataFrame:
    """Documents (Markdown) and configurations (YAML, Dockerfile) as nodes: label, id, properties, repository. Their text is kept
    whole. Null contents have no row, repeated rows count once."""
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    name = F.substring_index(path, "/", -1)
    label = F.when(F.lower(name).endswith(".md"), "Document").when(F.lower(name).rlike(r"\.ya?ml$|^dockerfile$"), "Configuration")
    kept = files.where(F.col("content").isNotNull()).select("repository", path.alias("path"), name.alias("name"), label.alias("label"), "content")
    return kept.where("label IS NOT NULL").dropDuplicates().select(
        "label", F.concat_ws("::", "repository", "path").alias("id"),
        F.create_map(F.lit("name"), "name", F.lit("file_path"), "path", F.lit("text"), "content").alias("properties"), "repository",
    )


def holders(nodes: DataFrame, rel: str) -> DataFrame:
    """(src_id, rel, dst_id, repository): the folder of each node's file, or the repository at the top. DEFINES points from the
    holder to the node, WEAK_LINK from the node to its holder. ``nodes`` has id, repository and file_path."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    holder = F.when(folder == "", F.col("repository")).otherwise(F.concat(F.col("repository"), F.lit("::dir::"), folder))
    ends = (holder, F.col("id")) if rel == "DEFINES" else (F.col("id"), holder)
    known = nodes.where(F.col("file_path").isNotNull() & (F.col("file_path") != "") & F.col("repository").isNotNull())
    return known.select(ends[0].alias("src_id"), F.lit(rel).alias("rel"), ends[1].alias("dst_id"), "repository").distinct()


def split_lines(lines: list[str], max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """Windows [first, last] of whole lines: as many as fit ``max_chars`` (one at least), each starting up to
    ``overlap_chars`` of lines before the end of the last one, but always further than it started."""
    out, start, n = [], 0, len(lines)
    sizes = [len(x) + 1 for x in lines]
    while start < n:
        end, left = start, max_chars
        while end < n and (end == start or sizes[end] <= left):
            left -= sizes[end]
            end += 1
        out.append((start, end - 1))
        if end >= n:
            break
        back, room = end, overlap_chars
        while back - 1 > start and sizes[back - 1] <= room:
            back -= 1
            room -= sizes[back]
        start = back
    return out


def windows(files: DataFrame, max_chars: int = 2048, overlap_chars: int = 256) -> DataFrame:
    """Line windows of every text: file_id, chunk_index, start_line, end_line, total_chunks, text. Null and empty have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, text in zip(batch["file_id"], batch["content"], strict=True):
                lines = textwrap.dedent(text).strip().splitlines()
                cut = split_lines(lines, max_chars, overlap_chars)
                rows += [(file_id, i, a + 1, b + 1, len(cut), "\n".join(lines[a : b + 1])) for i, (a, b) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["file_id", "chunk_index", "start_line", "end_line", "total_chunks", "text"])

    schema = "file_id bigint, chunk_index int, start_line int, end_line int, total_chunks int, text string"
    chosen = spread(files.where(F.col("content").isNotNull()).select("file_id", "content"))
    return chosen.mapInPandas(run, schema).dropDuplicates(["file_id", "chunk_index"])


#: Labels that are cut into chunks, and how many lines of a module are.
CHUNKED, MODULE_LINES = ["Module", "Class", "Function", "Document", "Configuration"], 257


def node_chunks(nodes: DataFrame, files: DataFrame, max_chars: int = 2048, overlap_chars: int = 256) -> DataFrame:
    """Chunks of every node's lines under a header: node_id, chunk_index, start_line, end_line, total_chunks, text.

    ``nodes`` has id, label, repository, name, class_name, type, file_path, line_start and line_end; ``files`` has repository,
    file_path and content, one row each. Placeholders have no source; a module is cut from its first lines only; nodes without
    lines are their whole file.
    """
    n = nodes.where(F.col("label").isin(CHUNKED) & (F.coalesce("type", F.lit("")) != "external"))
    f = files.where(F.col("content").isNotNull()).select(F.col("repository").alias("f_repository"), F.col("file_path").alias("f_path"), "content")
    joined = n.join(f, (F.col("file_path") == F.col("f_path")) & F.col("repository").eqNullSafe(F.col("f_repository")))
    first = F.coalesce("line_start", F.lit(1))
    last = F.when(F.col("label") == "Module", F.least(F.coalesce("line_end", F.lit(1 << 30)), first + MODULE_LINES - 1)).otherwise(F.col("line_end"))
    head = chunk_header(F.col("label"), F.col("class_name"), F.coalesce("name", "id"), F.col("file_path"), F.col("line_start"))
    # only the node's own lines leave the JVM
    lines = F.split("content", r"\r\n|\r|\n")
    part = F.slice(lines, first, F.greatest(F.coalesce(last, F.size(lines)) - first + 1, F.lit(0)))
    rows = joined.select("id", head.alias("head"), first.alias("first"), F.array_join(part, "\n").alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, head, first, part in zip(batch["id"], batch["head"], batch["first"], batch["part"], strict=True):
                text = textwrap.dedent(part).strip()
                if len(text) <= max_chars:
                    out.append((node, 0, first, first + part.count("\n"), 1, f"{head}\n{text}"))
                    continue
                lines = text.splitlines()
                cut = split_lines(lines, max_chars, overlap_chars)
                out += [(node, i, first + a, first + b, len(cut), "\n".join([head, *lines[a : b + 1]])) for i, (a, b) in enumerate(cut)]
            yield pd.DataFrame(out, columns=["node_id", "chunk_index", "start_line", "end_line", "total_chunks", "text"])

    return rows.mapInPandas(run, "node_id string, chunk_index int, start_line int, end_line int, total_chunks int, text string")


def skeleton(text: str, focus: set[str]) -> str:
    """``text`` with the bodies of functions outside ``focus`` (names, or Class.method) cut to their docstring and '...'; as it is
    if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text
    lines, cut = text.splitlines(), []
    owner = {m: c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for m in c.body}
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and not focus & {f.name, f"{owner.get(f)}.{f.name}"}:
            documented = ast.get_docstring(f) is not None
            first = f.body[0].end_lineno + 1 if documented else f.body[0].lineno
            inner = any(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x.name in focus for s in f.body for x in ast.walk(s))
            if not inner and first > f.lineno and (len(f.body) > 1 or not documented):
                cut.append((first, f.body[-1].end_lineno, " " * f.body[0].col_offset + "..."))
    end = 0
    kept = []
    for first, last, mark in sorted(cut):
        if first > end:
            kept += lines[end : first - 1] + [mark]
            end = last
    return "\n".join(kept + lines[end:])


def skeletons(files: DataFrame, focus: DataFrame) -> DataFrame:
    """file_id, skeleton of each file in ``focus`` (file_id, names: array of function names to keep whole)."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([skeleton(t, set(n)) if t is not None else None for t, n in zip(text, names, strict=True)])

    return files.select("file_id", "content").join(focus, "file_id").select("file_id", cut("content", "names").alias("skeleton"))
