"""Recursive-descent parsers that collect every error of a file: Python 3.13, Java 17, JSON and YAML."""

from __future__ import annotations

import sys

from loomgraph.llm.syntax import java_grammar, json_grammar, python_grammar, yaml_grammar

#: Parser by extension in lower case; other extensions have none.
PARSERS = {"py": python_grammar.errors, "java": java_grammar.errors, "json": json_grammar.errors, "yaml": yaml_grammar.errors, "yml": yaml_grammar.errors}
LANGUAGES = {"py": "python", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml"}


#: Python frames that a parser may nest; pure Python calls take no C stack.
DEPTH = 100_000


def check(extension: str, text: str) -> list[tuple[int, str]]:
    """(line, message) of every error, the first cause first. Nesting beyond what the parsers can follow is an error too."""
    usual = sys.getrecursionlimit()
    sys.setrecursionlimit(DEPTH)
    try:
        return PARSERS[extension](text)
    except RecursionError:
        return [(0, "nested too deeply")]
    finally:
        sys.setrecursionlimit(usual)
