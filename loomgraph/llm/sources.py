"""Source files that do not parse (problem 2), and functions paired with their documentation (problem 3).

Both read each file once, in the stage that scans it: contents are not shuffled (unless the scan has fewer splits than the
cluster has cores, see ``spread``), only the few columns of the result are.
Files that are delivered twice are parsed twice and counted once.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.spreading import spread
from loomgraph.llm.syntax import LANGUAGES, check

ERROR = "array<struct<line: int, message: string>>"


def extension(path: Column) -> Column:
    """The extension in lower case, without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _candidates(files: DataFrame, extensions: list[str]) -> DataFrame:
    kept = files.select("file_id", "repository", "file_path", extension(F.col("file_path")).alias("ext"), "content")
    return spread(kept.where(F.col("content").isNotNull() & F.col("ext").isin(extensions)))


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file of a known language: file_id, repository, file_path, language, accepted, line, cause, errors.

    ``cause`` and ``line`` are of the first error, ``errors`` holds all. Files with null content or of other extensions have no
    row; an empty file is judged as its language has it; a null path has no extension. Repeated rows count once.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [check(e, c) for e, c in zip(batch["ext"], batch["content"], strict=True)]
            yield pd.DataFrame(
                {
                    "file_id": batch["file_id"], "repository": batch["repository"], "file_path": batch["file_path"],
                    "language": batch["ext"].map(LANGUAGES), "accepted": [not e for e in found],
                    "line": pd.array([e[0][0] if e else None for e in found], dtype="Int32"),
                    "cause": [e[0][1] if e else None for e in found],
                    "errors": [[{"line": n, "message": m} for n, m in e] for e in found],
                }
            )

    schema = f"file_id bigint, repository string, file_path string, language string, accepted boolean, line int, cause string, errors {ERROR}"
    return _candidates(files, sorted(LANGUAGES)).mapInPandas(parse, schema).dropDuplicates(["file_id"])


def acceptance(parsed: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language: repository, language, files, invalid, rate."""
    bad = F.sum(F.when(F.col("accepted"), 0).otherwise(1))
    return parsed.groupBy("repository", "language").agg(
        F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate")
    )


def _path(path: Column) -> Column:
    """A path as one would compare it: forward slashes, no leading './', '/' or 'src/', lower case."""
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(?:\./|/)+(?:src/)?|^src/|(?<=/)(?:\./|/)+", "")


def broken_chunks(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks cut from invalid files: file_id, node_id, chunk_index. Paths are compared whatever their spelling."""
    bad = parsed.where(~F.col("accepted")).select("file_id", F.col("repository").alias("repo"), _path(F.col("file_path")).alias("path"))
    cut = chunks.select("node_id", "chunk_index", "repository", _path(F.col("file_path")).alias("chunk_path"))
    on = (F.col("path") == F.col("chunk_path")) & F.col("repo").eqNullSafe(F.col("repository"))
    return cut.join(bad, on).select("file_id", "node_id", "chunk_index").distinct()


# -- functions with their documentation

_PY = r"""
(?(DEFINE)
  (?P<note>\#[^\n]*+)
  (?P<quotes>'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+")
  (?P<field>\{(?:[^{}'"]++|(?&text)|(?&field))*+\})
  (?P<text>(?i:[bru]|br|rb)?(?&quotes)
    |(?i:fr?|rf)(?:'''(?:\{\{|(?&field)|\\.|(?!''')[^\\{])*+'''|\"\"\"(?:\{\{|(?&field)|\\.|(?!\"\"\")[^\\{])*+\"\"\"
      |'(?:\{\{|(?&field)|\\.|[^'\\{\n])*+'|"(?:\{\{|(?&field)|\\.|[^"\\{\n])*+"))
  (?P<group>\((?:(?&part)|:)*+\)|\[(?:(?&part)|:)*+\]|\{(?:(?&part)|:)*+\})
  (?P<part>(?&text)|(?&note)|(?&group)|\w++|[^()\[\]{}'"\#\w:]++)
)
(?:[^\w'"\#]++|(?!(?:async|def)\b)\w++(?!['"])|(?&note)|(?<!\w)(?&text))(*SKIP)(*FAIL)
|(?<![\w.])(?P<head>(?:async[ \t\\\n]++)?def[ \t\\\n]++)(?P<name>\w++)\s*+(?P<types>\[(?:(?&part)|:)*+\])?\s*+
 (?P<params>\((?:(?&part)|:)*+\))(?:(?:[ \t]|\\\n)*+->(?:(?&text)|(?&group)|\w++|\\\n|[^()\[\]{}'"\#\w:\n]++)*+)?(?:[ \t]|\\\n)*+:
 (?=(?:[ \t]*+(?&note)?\n(?:[ \t\f]*+(?&note)?\n)*+[ \t\f]++|[ \t]*+)
    (?P<doc>(?:[rRuU]?(?&quotes)(?:[ \t]|\\\n)*+)++|\((?:\s*+[rRuU]?(?&quotes)\s*+)++\)[ \t]*+)(?:;|(?&note)|\n|\Z))
"""
_JAVA = r"""
(?(DEFINE)
  (?P<note>//[^\n]*+|/\*(?:(?!\*/).)*+\*/)
  (?P<text>\"\"\"[ \t\f]*\n(?:[^\\"]|\\.|"(?!""))*+\"\"\"|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)++')
  (?P<round>\((?:[^()"'/]++|(?&note)|(?&text)|(?&round)|/)*+\))
  (?P<curly>\{(?:[^{}"'/]++|(?&note)|(?&text)|(?&curly)|/)*+\})
  (?P<angle><(?:[^<>(){};"]|(?&angle))*+>)
  (?P<mark>@(?!interface\b)\w++(?:\s*+\.\s*+\w++)*+(?:\s*+(?&round))?)
)
(?P<doc>/\*\*(?!/)(?:(?!\*/).)*+\*/)\s*+
(?P<marks>(?:(?:(?&mark)|\b(?:public|protected|private|static|abstract|final|native|synchronized|strictfp|default)\b)\s*+)*+)
(?P<types>(?&angle)\s*+)?(?:(?&mark)\s*+)*+
(?:(?!(?:return|new|throw|else|case|assert|yield|class|interface|enum|record|import|package|do|try)\b)
   \w++(?:\s*+(?&angle))?(?:\s*+\.\s*+\w++(?:\s*+(?&angle))?)*+(?:\s*+\[\s*+\])*+\s*+)?+
(?<!\w)(?P<name>(?!(?:if|for|while|switch|synchronized|catch|return|new|super|this)\b)[^\W\d]\w*+)\s*+(?P<params>(?&round))(?:\s*+\[\s*+\])*+
(?:\s*+throws\b[\w\s.,<>@?&]++)?(?:\s*+default\b[^;]*+)?\s*+(?=(?P<body>(?&curly))|;)
|(?:[^/"']++|(?&note)|(?&text))(*SKIP)(*FAIL)
"""
_python = regex.compile(_PY, regex.X | regex.S | regex.M)
_java = regex.compile(_JAVA, regex.X | regex.S)
_word = regex.compile(r"[\p{L}\p{N}]+")
_name_part = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|[^\p{Lu}\p{Ll}\W\d_]+|\d+")
_field_line = regex.compile(r"\s*(?::param|:return|@param|@return|@throws)")
MIN_WORDS = 4


def telling_words(name: str, documentation: str) -> int:
    """Words of the documentation that are neither the function's own nor on lines about parameters, results or exceptions."""
    own = {p.lower() for p in _name_part.findall(name)}
    lines = [line for line in documentation.split("\n") if not _field_line.match(line)]
    return sum(w.lower() not in own for line in lines for w in _word.findall(line))


def _python_body(text: str, start: int, colon: int) -> str:
    """The definition with its block: the lines that are indented more than it, or blank, or inside brackets or strings."""
    line = text.rfind("\n", 0, start) + 1
    indent = len(text[line:start].expandtabs(8))
    end = text.find("\n", colon)
    if end < 0:
        return text[start:]
    if text[colon:end].split("#")[0].strip():
        return text[start:end]
    last = end
    while end < len(text):
        nxt = text.find("\n", end + 1)
        nxt = len(text) if nxt < 0 else nxt
        row = text[end + 1 : nxt]
        if row.strip():
            if len(row.expandtabs(8)) - len(row.expandtabs(8).lstrip()) <= indent and not row.lstrip().startswith("#"):
                break
            last = nxt
        end = nxt
    return text[start:last]


def functions(ext: str, content: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, name, documentation, code) of every documented function, nested ones included."""
    text = content.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    line, at = 1, 0
    for m in (_python if ext == "py" else _java).finditer(text):
        line += text.count("\n", at, m.start("name"))
        at = m.start("name")
        if ext == "py":
            doc = ast.literal_eval(f"({m['doc'].strip()})")
            code = _python_body(text, m.start(), m.end() - 1)
        else:
            doc = "\n".join(regex.sub(r"^\s*\*+", "", row) for row in m["doc"][3:-2].split("\n"))
            code = text[m.end("doc") : m.end()].lstrip() + (m["body"] or ";")
        yield line, m["name"], doc, code


def documented_functions(files: DataFrame) -> DataFrame:
    """Pairs of code and description: file_id, line, name, description, code.

    For Python and Java files with content that parse; functions with fewer than ``MIN_WORDS`` telling words have no row.
    Repeated rows count once; other columns are ignored; an empty table gives an empty result.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (file_id, *pair)
                for file_id, ext, content in zip(batch["file_id"], batch["ext"], batch["content"], strict=True)
                if not check(ext, content)
                for pair in functions(ext, content)
                if telling_words(pair[1], pair[2]) >= MIN_WORDS
            ]
            yield pd.DataFrame(rows, columns=["file_id", "line", "name", "description", "code"])

    schema = "file_id bigint, line int, name string, description string, code string"
    return _candidates(files, ["py", "java"]).mapInPandas(extract, schema).dropDuplicates(["file_id", "line", "name"])
