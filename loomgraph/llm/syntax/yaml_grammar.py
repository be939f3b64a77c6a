"""YAML: recursive descent over block and flow nodes, recovering at the next document or the next line of the outermost level.

Simple keys end on their line, a tab starts no token, and a document separator ends any block, as YAML 1.1 has it.
"""

from __future__ import annotations

import regex

from loomgraph.llm.syntax.base import Fault

_unprintable = regex.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_separator = regex.compile(r"(?:---|\.\.\.)(?=[ \t\n]|$)")
_property = regex.compile(r"&[\w-]+|!<[^>\n]*>|![^\s\[\]{},]*")
_alias = regex.compile(r"\*([\w-]+)")
_anchor_end = regex.compile(r"(?=[\s?:,\]}%@`]|$)")
_block_header = regex.compile(r"[|>](?:[+-][1-9]?|[1-9][+-]?)?(?= *(?:#|\n|$))")
_escape = regex.compile(r"\\(?:[0abt\tnvfre \"/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")
KEY_LENGTH = 1024


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, len(text)
        self.flow = 0
        self.single = False
        self.fresh = True
        self.anchors: set[str] = set()
        self.found: list[tuple[int, str]] = []

    # -- characters

    def fail(self, message: str) -> None:
        raise Fault(self.text.count("\n", 0, self.at) + 1, message)

    def char(self, n: int = 0) -> str:
        return self.text[self.at + n : self.at + n + 1]

    def col(self) -> int:
        return self.at - self.text.rfind("\n", 0, self.at) - 1

    def blank(self, n: int = 0) -> bool:
        return self.char(n) in ("", " ", "\t", "\n")

    def newline(self) -> None:
        if self.single:
            self.fail("a simple key ends on its line")
        self.at += 1
        self.fresh = True

    def skip(self) -> None:
        """To the next token."""
        while True:
            while self.char() == " ":
                self.at += 1
            if self.char() == "#":
                end = self.text.find("\n", self.at)
                self.at = self.n if end < 0 else end
            if self.char() != "\n":
                return
            self.newline()

    def ended(self) -> bool:
        return self.at >= self.n or (self.col() == 0 and _separator.match(self.text, self.at) is not None)

    # -- block nodes

    def block_node(self, parent: int, compact: bool, in_map: bool = False) -> None:
        """A node indented more than ``parent``; a collection may start on this line only if ``compact``."""
        self.fresh = False
        self.skip()
        compact |= self.fresh
        if self.ended():
            return
        c = self.col()
        entry = self.char() == "-" and self.blank(1)
        if self.fresh and c <= parent:
            if in_map and c == parent and entry:
                self.block_sequence(c, True)
            return
        if entry:
            if not compact:
                self.fail("sequence entries are not allowed here")
            self.block_sequence(c, False)
        elif self.char() == "?" and self.blank(1):
            if not compact:
                self.fail("mapping keys are not allowed here")
            self.block_mapping(c)
        elif compact and self.at_key():
            self.block_mapping(c)
        elif self.char() in ("&", "!") and self.char():
            self.property()
            self.block_node(parent, False, in_map)
        elif self.char() in ("|", ">") and self.char():
            self.block_scalar(parent)
        else:
            self.fresh = False
            self.flow_node(parent + 1)
            if not self.fresh:
                self.rest_of_line()

    def rest_of_line(self) -> None:
        while self.char() == " ":
            self.at += 1
        if self.char() == ":" and self.blank(1):
            self.fail("mapping values are not allowed here")
        if self.char() not in ("", "\n", "#"):
            self.fail(f"found {self.char()!r} after a complete node")

    def next_entry(self, c: int) -> bool:
        """Whether another entry of the collection at column ``c`` follows."""
        self.skip()
        if self.ended() or (self.fresh and self.col() < c):
            return False
        if not self.fresh or self.col() > c:
            self.fail("expected the end of a block")
        return True

    def block_sequence(self, c: int, indentless: bool) -> None:
        while True:
            self.at += 1
            self.block_node(c, True)
            if not self.next_entry(c):
                return
            if not (self.char() == "-" and self.blank(1)):
                if indentless:
                    return
                self.fail("expected '-'")

    def at_key(self) -> bool:
        """Whether a simple key and its ':' stand here; moves nowhere."""
        state = self.at, self.fresh, self.flow, self.single
        self.single = True
        try:
            self.key()
            return self.char() == ":" and self.blank(1) and self.at - state[0] <= KEY_LENGTH
        except Fault:
            return False
        finally:
            self.at, self.fresh, self.flow, self.single = state

    def key(self) -> None:
        while self.char() in ("&", "!") and self.char():
            self.property()
            while self.char() == " ":
                self.at += 1
        if not (self.char() == ":" and self.blank(1)):
            self.flow_node(0)
        while self.char() == " ":
            self.at += 1

    def block_mapping(self, c: int) -> None:
        while True:
            if self.char() == "?" and self.blank(1):
                self.at += 1
                self.block_node(c, True, True)
                self.skip()
                if not self.ended() and self.fresh and self.col() == c and self.char() == ":" and self.blank(1):
                    self.at += 1
                    self.block_node(c, True, True)
            elif self.at_key():
                self.single = True
                self.key()
                self.single = False
                self.at += 1
                self.block_node(c, False, True)
            else:
                self.flow_node(0)  # its own error comes first
                self.fail("could not find expected ':'")
            try:
                if not self.next_entry(c):
                    return
            except Fault as e:
                if c:
                    raise
                self.recover(e)
                if self.ended():
                    return
            if self.char() == "-" and self.blank(1):
                self.fail("expected a key, found '-'")

    def recover(self, e: Fault) -> None:
        """Panic mode: to the next line that starts in the first column with a letter or a separator."""
        self.found.append((e.line, e.message))
        self.single, self.flow = False, 0
        m = regex.compile(r"\n(?=[\w\"]|---|\.\.\.)").search(self.text, self.at)
        self.at = m.end() if m else self.n
        self.fresh = True

    def block_scalar(self, parent: int) -> None:
        m = _block_header.match(self.text, self.at)
        if not m:
            self.fail("expected chomping or indentation indicators")
        least = max(parent + 1, 1)
        width = next((int(x) for x in m[0] if x.isdigit()), 0)
        end = self.text.find("\n", self.at)
        self.at = self.n if end < 0 else end
        indent = max(parent, 0) + width if width else 0
        widest = 0
        while self.at < self.n:
            line = self.at + 1
            stop = self.text.find("\n", line)
            stop = self.n if stop < 0 else stop
            spaces = line
            while spaces < stop and self.text[spaces] == " ":
                spaces += 1
            lead = spaces - line
            if not indent:
                if spaces == stop:
                    widest = max(widest, lead)
                    self.at = stop
                    continue
                indent = max(least, widest, lead) if lead >= least else max(least, widest)
            if spaces < stop and lead < indent:
                break
            self.at = stop
        self.fresh = False
        if self.at < self.n:
            self.newline()
        self.fresh = True

    # -- flow nodes

    def property(self) -> None:
        m = _property.match(self.text, self.at)
        if not m or not _anchor_end.match(self.text, m.end()):
            self.fail("invalid anchor or tag")
        if m[0][0] == "&":
            self.anchors.add(m[0][1:])
        self.at = m.end()

    def flow_node(self, least: int) -> None:
        c = self.char()
        if c in ("[", "{"):
            self.collection("]" if c == "[" else "}")
        elif c in ("'", '"'):
            self.quoted(c)
        elif c == "*":
            m = _alias.match(self.text, self.at)
            if not m or not _anchor_end.match(self.text, m.end()):
                self.fail("invalid alias")
            if m[1] not in self.anchors:
                self.fail("undefined alias")
            self.at = m.end()
        elif c and c in ("&", "!") and self.flow:
            self.property()
            self.skip()
            if self.char() not in (",", "]", "}", ":"):
                self.flow_node(least)
        else:
            self.plain(least)

    def collection(self, close: str) -> None:
        self.at += 1
        self.flow += 1
        while True:
            self.skip()
            if self.char() == close:
                break
            if self.char() == "?" and self.blank(1):
                self.at += 1
                self.skip()
            if self.char() != ":":
                self.flow_node(0)
            self.skip()
            if self.char() == ":":
                self.at += 1
                self.skip()
                if self.char() not in (",", close):
                    self.flow_node(0)
                self.skip()
            if self.char() == close:
                break
            if self.char() != ",":
                self.fail(f"expected ',' or '{close}'")
            self.at += 1
        self.at += 1
        self.flow -= 1

    def quoted(self, quote: str) -> None:
        self.at += 1
        while True:
            c = self.char()
            if not c:
                self.fail("found the end of the file in a quoted scalar")
            if c == "\n":
                self.newline()
                if _separator.match(self.text, self.at):
                    self.fail("found a document separator in a quoted scalar")
                continue
            if c == quote:
                if quote == "'" and self.char(1) == "'":
                    self.at += 2
                    continue
                break
            if c == "\\" and quote == '"':
                m = _escape.match(self.text, self.at)
                if not m:
                    self.fail("unknown escape in a quoted scalar")
                if m[0][1] == "\n" and self.single:
                    self.fail("a simple key ends on its line")
                self.at = m.end()
                continue
            self.at += 1
        self.at += 1
        self.fresh = False

    def plain(self, least: int) -> None:
        c = self.char()
        starts = c and c not in "\t\n -?:,[]{}#&*!|>'\"%@`" or (
            c and c in "-?:" and not self.blank(1) and (c == "-" or not self.flow)
        )
        if not starts:
            self.fail(f"found character {c!r} that cannot start any token")
        self.fresh = False
        stop = ",?[]{}" if self.flow else ""
        first = True
        while self.char() != "#" or first:
            start = self.at
            while not self.blank():
                c = self.char()
                if c == ":" and (self.blank(1) or (self.flow and self.char(1) in ",[]{}")) or c in stop and c:
                    break
                self.at += 1
            if self.at == start:
                return
            first = self.fresh = False
            while self.char() == " ":
                self.at += 1
            if self.char() == "\n":
                if self.single:
                    return
                while self.char() == "\n":
                    self.newline()
                    if _separator.match(self.text, self.at):
                        return
                    while self.char() == " ":
                        self.at += 1
                if not self.flow and self.col() < least:
                    return

    # -- documents

    def file(self) -> None:
        open_end = True
        while True:
            self.skip()
            if self.at >= self.n:
                return
            try:
                directives = False
                while self.char() == "%" and self.col() == 0 and open_end:
                    directives = True
                    end = self.text.find("\n", self.at)
                    self.at = self.n if end < 0 else end
                    self.skip()
                m = _separator.match(self.text, self.at) if self.col() == 0 else None
                if m and m[0] == "---":
                    self.at += 3
                    self.anchors = set()
                    self.block_node(-1, False)
                elif m:
                    self.at += 3
                    self.rest_of_line()
                    open_end = True
                    continue
                elif directives or not open_end:
                    self.fail("expected the start of a document")
                else:
                    self.block_node(-1, True)
                open_end = False
            except Fault as e:
                self.recover(e)
                open_end = True


def errors(text: str) -> list[tuple[int, str]]:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    p = Parser(text)
    if m := _unprintable.search(text):
        p.found.append((text.count("\n", 0, m.start()) + 1, "special characters are not allowed"))
    p.file()
    return sorted(p.found, key=lambda e: e[0])
