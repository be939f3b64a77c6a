"""JSON as RFC 8259 has it."""

from __future__ import annotations

import regex

from loomgraph.llm.syntax.base import Cursor, Fault, Token

_token = regex.compile(
    r"(?P<blank>[ \t\n\r]+)|(?P<string>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")"
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|(?P<op>[{}\[\]:,])|(?P<name>[A-Za-z_]\w*)|(?P<other>.)",
    regex.S,
)


def _tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _token.finditer(text):
        if m.lastgroup != "blank":
            out.append(Token(m.lastgroup, m[0], line, m.start()))
        line += m[0].count("\n")
    return [*out, Token("end", "", line, len(text))]


class Parser(Cursor):
    def value(self) -> None:
        t = self.now
        if t.kind in ("string", "number") or self.is_word("true", "false", "null"):
            self.take()
        elif self.skip_op("{"):
            self.members("}", self.member)
        elif self.skip_op("["):
            self.members("]", self.value)
        else:
            self.fail("expected a value")

    def member(self) -> None:
        if self.now.kind != "string":
            self.fail("expected a name in double quotes")
        self.take()
        self.need_op(":")
        self.value()

    def members(self, close: str, one) -> None:
        if self.skip_op(close):
            return
        while True:
            try:
                one()
                if self.skip_op(close):
                    return
                self.need_op(",")
            except Fault as e:  # panic: to the next comma or the end of this level
                self.note(e)
                depth = 0
                while self.now.kind != "end" and not (depth == 0 and self.is_op(",", close)):
                    depth += self.is_op("{", "[") - self.is_op("}", "]")
                    if depth < 0:
                        return
                    self.take()
                if self.now.kind == "end" or self.take().text == close:
                    return


def _valid(tokens: list[Token]) -> bool:
    """Whether the tokens are one value, however deep; a loop, since a descent would end at some depth."""
    stack: list[str] = []
    i, want = 0, "value"
    while True:
        t = tokens[i]
        i += 1
        if want == "end":
            return t.kind == "end"
        if want in ("value", "first"):
            if t.kind == "op" and t.text in "[{" and t.text:
                stack.append(t.text)
                want = "first" if t.text == "[" else "first name"
                continue
            if want == "first" and t.kind == "op" and t.text == "]":
                stack.pop()
            elif not (t.kind in ("string", "number") or t.kind == "name" and t.text in ("true", "false", "null")):
                return False
        elif want in ("first name", "name"):
            if want == "first name" and t.kind == "op" and t.text == "}":
                stack.pop()
            elif t.kind != "string" or tokens[i].text != ":" or tokens[i].kind != "op":
                return False
            else:
                i, want = i + 1, "value"
                continue
        elif t.kind == "op" and t.text == ",":
            want = "value" if stack[-1] == "[" else "name"
            continue
        elif t.kind == "op" and t.text == {"[": "]", "{": "}"}[stack[-1]]:
            stack.pop()
        else:
            return False
        want = "more" if stack else "end"


def errors(text: str) -> list[tuple[int, str]]:
    tokens = _tokens(text.removeprefix("\ufeff"))
    if _valid(tokens):
        return []
    p = Parser(tokens)
    try:
        p.value()
        if p.now.kind != "end":
            p.fail("expected the end of the file")
    except Fault as e:
        p.note(e)
    return p.found
