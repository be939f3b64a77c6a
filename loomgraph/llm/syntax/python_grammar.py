"""Python 3.13: recursive-descent statements, precedence-climbing expressions, panic-mode recovery at line ends."""

from __future__ import annotations

import re
import unicodedata

import regex

from loomgraph.llm.syntax.base import Cursor, Fault, Token

KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield".split()
)
FEATURES = frozenset(
    "nested_scopes generators division absolute_import with_statement print_function unicode_literals barry_as_FLUFL "
    "generator_stop annotations".split()
)
ASSIGN = ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")

_name = regex.compile(r"[\p{XID_Start}_]\p{XID_Continue}*")
_number = regex.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
)
_op = regex.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=]")
#: The usual tokens at one go, with the blanks before them; all else is left to ``Lexer.token``.
_usual = re.compile(
    r"[ \t\f]*+(?:(?P<name>[A-Za-z_][A-Za-z_0-9]*+)(?![\w'\"]|[^\x00-\x7f])|(?P<bracket>[()\[\]{}])|(?P<number>[1-9][0-9]*+|0)(?![\w.]|[^\x00-\x7f])"
    r"|(?P<op>\*\*=?|//=?|>>=?|<<=?|->|:=|[=!<>+\-*/%@&|^]=|\.(?![0-9.])|[-+*/%@&|^~<>,:;=])|(?P<line>\n)|(?P<note>#[^\n]*+)|(?P<join>\\\n))"
)
_prefix = regex.compile(r"(?i)(?:r|u|b|f|br|rb|fr|rf)?(?='|\")")
_blank = regex.compile(r"(?:[ \t\f]|\\\r?\n)+")
_escape = regex.compile(r"\\(?:N\{([^}]*)\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U([0-9a-fA-F]{8})|([NxuU])|.)", regex.S)


class Lexer:
    """Tokens of a text; ``found`` has the errors. Strings are one token each; their fields in braces are parsed on the way."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1
        self.out: list[Token] = []
        self.found: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = []

    def note(self, message: str, line: int | None = None) -> None:
        self.found.append((self.line if line is None else line, message))

    def emit(self, kind: str, text: str) -> None:
        self.out.append(Token(kind, text, self.line, self.at))

    def run(self) -> list[Token]:
        levels, text, n, out = [(0, 0)], self.text, len(self.text), self.out
        fresh = True
        while self.at < n:
            if fresh and not self.open:
                self._indent(levels)
                fresh = False
                continue
            m = _usual.match(text, self.at)
            kind = m.lastgroup if m else ""
            if kind in ("name", "op", "number"):
                out.append(Token(kind, m[kind], self.line, self.at))
                self.at = m.end()
            elif kind == "bracket":
                self.bracket(m[kind])
                out.append(Token("op", m[kind], self.line, self.at))
                self.at = m.end()
            elif kind == "line":
                if not self.open and out and out[-1].kind not in ("newline", "indent", "dedent"):
                    self.emit("newline", "")
                self.at = m.end()
                self.line += 1
                fresh = not self.open
            elif m:
                self.line += kind == "join"
                self.at = m.end()
            elif m := _blank.match(text, self.at):
                self.line += m[0].count("\n")
                self.at = m.end()
            else:
                self.token()
        if self.open:
            self.note(f"'{self.open[-1][0]}' was never closed", self.open[-1][1])
        if self.out and self.out[-1].kind not in ("newline", "indent", "dedent"):
            self.emit("newline", "")
        for _ in levels[1:]:
            self.emit("dedent", "")
        self.emit("end", "")
        return self.out

    def _indent(self, levels: list[tuple[int, int]]) -> None:
        """At a line's start: counts its indentation with tabs of eight and of one, which must compare alike."""
        text, n, wide, narrow, at = self.text, len(self.text), 0, 0, self.at
        while at < n and text[at] in " \t\f":
            if text[at] == "\f":
                wide = narrow = 0
            else:
                wide = wide + 1 if text[at] == " " else wide // 8 * 8 + 8
                narrow += 1
            at += 1
        self.at = at
        if at >= n or text[at] in "\n#" or (text[at] == "\\" and text[at + 1 : at + 2] == "\n"):
            return
        top = levels[-1]
        if (wide > top[0]) != (narrow > top[1]) or (wide == top[0]) != (narrow == top[1]):
            self.note("inconsistent use of tabs and spaces in indentation")
        if wide > top[0]:
            levels.append((wide, narrow))
            self.emit("indent", "")
        elif wide < top[0]:
            while wide < levels[-1][0]:
                levels.pop()
                self.emit("dedent", "")
            if wide != levels[-1][0]:
                self.note("unindent does not match any outer indentation level")
                levels[-1] = (wide, narrow) if len(levels) > 1 else levels[-1]
            elif narrow != levels[-1][1]:
                self.note("inconsistent use of tabs and spaces in indentation")

    def token(self) -> None:
        text = self.text
        if (m := _prefix.match(text, self.at)) is not None:
            self.string(m[0].lower())
        elif m := _name.match(text, self.at):
            self.emit("name", m[0])
            self.at = m.end()
        elif text[self.at].isdigit() or (text[self.at] == "." and text[self.at + 1 : self.at + 2].isdigit()):
            self.number()
        elif m := _op.match(text, self.at):
            self.bracket(m[0])
            self.emit("op", m[0])
            self.at = m.end()
        elif text[self.at] == "!" and self.out:
            self.emit("op", "!")
            self.at += 1
        else:
            self.note(f"invalid character {text[self.at]!r}")
            self.emit("bad", text[self.at])
            self.at += 1

    def bracket(self, op: str) -> None:
        if op in "([{":
            if len(self.open) == MAX_BRACKETS:
                self.note("too many nested parentheses")
            self.open.append((op, self.line))
        elif op in ")]}":
            if not self.open:
                self.note(f"unmatched '{op}'")
            elif self.open.pop()[0] != {")": "(", "]": "[", "}": "{"}[op]:
                self.note(f"closing '{op}' does not match")

    def number(self) -> None:
        m = _number.match(self.text, self.at)
        if m is None:
            self.note("invalid number")
            self.emit("number", "0")
            self.at += 1
            return
        tail = _name.match(self.text, m.end())
        if tail and not regex.match(r"(?:and|else|for|if|in|is|not|or)\b", tail[0]):
            self.note("invalid decimal literal")
            end = tail.end()
        else:
            end = m.end()
            if regex.fullmatch(r"0[0-9_]*[1-9][0-9_]*", m[0]):
                self.note("leading zeros in decimal integer literals are not permitted")
        self.emit("number", m[0])
        self.at = end

    def string(self, prefix: str) -> None:
        text, start, line = self.text, self.at, self.line
        self.at += len(prefix)
        quote = text[self.at]
        if text.startswith(quote * 3, self.at):
            quote *= 3
        self.at += len(quote)
        token = Token("bytes" if "b" in prefix else "fstring" if "f" in prefix else "string", "", line, start)
        body = self.at
        if "f" in prefix:
            closed = self.formatted(quote, "r" in prefix, False)
        else:
            closed = self.plain(quote)
        if not closed:
            self.note(f"unterminated {'triple-quoted ' * (len(quote) == 3)}string literal", line)
        raw = text[body : self.at - len(quote) * closed]
        if "b" in prefix and not raw.isascii():
            self.note("bytes can only contain ASCII literal characters", line)
        if "r" not in prefix and "f" not in prefix and "\\" in raw:
            self.escapes(raw, "b" in prefix, line)
        self.out.append(token._replace(text=text[start : self.at]))

    def escapes(self, raw: str, is_bytes: bool, line: int) -> None:
        for m in _escape.finditer(raw):
            bad = m[3] is not None and not (is_bytes and m[3] != "x")
            if m[1] is not None and not is_bytes:
                try:
                    unicodedata.lookup(m[1])
                except KeyError:
                    bad = True
            bad |= m[2] is not None and not is_bytes and int(m[2], 16) > 0x10FFFF
            if bad:
                self.note("invalid escape in string", line)
                return

    def plain(self, quote: str) -> bool:
        text, n = self.text, len(self.text)
        while self.at < n:
            c = text[self.at]
            if c == "\\":
                self.line += text[self.at + 1 : self.at + 2] == "\n"
                self.at += 2
            elif text.startswith(quote, self.at):
                self.at += len(quote)
                return True
            elif c == "\n":
                if len(quote) == 1:
                    return False
                self.at += 1
                self.line += 1
            else:
                self.at += 1
        self.at = min(self.at, n)
        return False

    def formatted(self, quote: str, raw: bool, spec: bool) -> bool:
        """The text of an f-string, or of a format specification up to its closing brace."""
        text, n = self.text, len(self.text)
        while self.at < n:
            c = text[self.at]
            if text.startswith(quote, self.at):
                if spec:
                    return False
                self.at += len(quote)
                return True
            if c == "\\" and not raw and text[self.at + 1 : self.at + 3] == "N{":
                self.at = max(text.find("}", self.at) + 1, self.at + 2)
            elif c == "\\" and not (raw and text[self.at + 1 : self.at + 2] in "{}"):
                step = 1 if text[self.at + 1 : self.at + 2] in "{}" else 2
                self.line += text[self.at + 1 : self.at + 2] == "\n" and step == 2
                self.at += step
            elif c == "{":
                if not spec and text.startswith("{{", self.at):
                    self.at += 2
                else:
                    self.at += 1
                    if not self.field(quote, raw):
                        return False
            elif c == "}":
                if spec:
                    return True
                if text.startswith("}}", self.at):
                    self.at += 2
                else:
                    self.note("f-string: single '}' is not allowed")
                    self.at += 1
            elif c == "\n":
                if len(quote) == 1:
                    return False
                self.at += 1
                self.line += 1
            else:
                self.at += 1
        return False

    def field(self, quote: str, raw: bool) -> bool:
        """After the brace: an expression, then perhaps '=', a conversion and a specification, then the closing brace."""
        text, n, line = self.text, len(self.text), self.line
        inner, self.out, outer_open, self.open = self.out, [], self.open, []
        closed = False
        while self.at < n:
            c = text[self.at]
            if not self.open and (c == "}" or (c == "!" and text[self.at + 1 : self.at + 2] != "=") or c == ":"):
                break
            if not self.open and c == "=" and regex.match(r"=\s*[!:}]", text[self.at :][:40]):
                self.at += 1
                break
            if c == "\n":
                self.at += 1
                self.line += 1
            elif m := _blank.match(text, self.at):
                self.line += m[0].count("\n")
                self.at = m.end()
            elif c == "#":
                self.at = text.find("\n", self.at) if "\n" in text[self.at :] else n
            elif c == "\\":
                self.note("f-string: unexpected backslash")
                self.at += 1
            else:
                self.token()
        self.emit("newline", "")
        self.emit("end", "")
        tokens, self.out = self.out, inner
        if self.open:
            self.note("f-string: bracket was never closed", line)
        self.open = outer_open
        p = Parser(tokens)
        try:
            p.star_or_yield()
            if p.now.kind != "newline":
                p.fail("f-string: invalid syntax")
        except Fault as e:
            self.note(f"f-string: {e.message}", line)
        while self.at < n and text[self.at] in " \t\n":
            self.line += text[self.at] == "\n"
            self.at += 1
        if text.startswith("!", self.at):
            m = regex.compile(r"![rsa](?=\s*[:}])").match(text, self.at)
            if not m:
                self.note("f-string: invalid conversion character", line)
            self.at = m.end() if m else self.at + 1
            while self.at < n and text[self.at] in " \t":
                self.at += 1
        if text.startswith(":", self.at):
            self.at += 1
            self.formatted(quote, raw, True)
        if text.startswith("}", self.at):
            self.at += 1
            closed = True
        if not closed:
            self.note("f-string: expecting '}'", line)
        return closed


#: Binary operators by binding power; all but '**' group to the left.
POWER = {
    "or": 1, "and": 2, "in": 4, "is": 4, "not": 4, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4,
    "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10,
}
UNARY, NOT = 11, 3


class Parser(Cursor):
    """Expressions return what an assignment needs to know of them: a kind, and for groups their parts."""

    def __init__(self, tokens: list[Token]):
        super().__init__(tokens)
        self.scopes = ["module"]
        self.loops = [0]
        self.docs = True  # only docstrings and __future__ imports so far

    # -- expressions

    def star_or_yield(self):
        return self.yielded() if self.is_word("yield") else self.star_expressions()

    def yielded(self):
        self.need_word("yield")
        if self.scopes[-1] in ("module", "class") and self.in_file:
            self.fail("'yield' outside function")
        if self.skip_word("from"):
            self.expression()
        elif not (self.now.kind in ("newline", "end") or self.is_op(")", "]", "}", "=", ";")):
            self.star_expressions()
        return ("yield", ())

    in_file = False

    def star_expressions(self):
        first = self.star_expression()
        if not self.is_op(","):
            return first
        parts = [first]
        while self.skip_op(","):
            if not self.starts_expression():
                break
            parts.append(self.star_expression())
        return ("tuple", parts)

    def star_expression(self):
        if self.skip_op("*"):
            self.binary(5)
            return ("star", (self.last,))
        return self.named()

    def starts_expression(self) -> bool:
        t = self.now
        if t.kind == "name":
            return t.text not in KEYWORDS or t.text in ("None", "True", "False", "not", "lambda", "await", "yield")
        return t.kind in ("number", "string", "fstring", "bytes") or self.is_op("(", "[", "{", "-", "+", "~", "...", "*")

    def named(self):
        if self.now.kind == "name" and self.now.text not in KEYWORDS and self.ahead().kind == "op" and self.ahead().text == ":=":
            self.take()
            self.take()
            self.expression()
            return ("named", ())
        return self.expression()

    def expression(self):
        if self.is_word("lambda"):
            return self.lambda_()
        out = self.binary(1)
        if self.skip_word("if"):
            self.binary(1)
            self.need_word("else")
            self.expression()
            return ("conditional", ())
        return out

    last = ("other", ())

    def lambda_(self):
        self.need_word("lambda")
        self.parameters(":", False)
        self.need_op(":")
        self.scopes.append("function")
        self.expression()
        self.scopes.pop()
        return ("lambda", ())

    def binary(self, least: int):
        """Precedence climbing: operands and operators that bind at least as strongly as ``least``."""
        if least <= NOT and self.is_word("not"):
            self.take()
            self.binary(NOT)
            left = ("other", ())
        else:
            left = self.unary()
        while True:
            t = self.now
            power = POWER.get(t.text) if t.kind in ("op", "name") else None
            if power is None or power < least:
                break
            if t.text == "not":
                if not (self.ahead().kind == "name" and self.ahead().text == "in"):
                    break
                self.take()
            self.take()
            if t.text == "is":
                self.skip_word("not")
            self.binary(power + 1)
            left = ("operation", ())
        self.last = left
        return left

    def unary(self):
        if self.is_op("-", "+", "~"):
            self.take()
            self.unary()
            return ("operation", ())
        if self.is_word("await"):
            self.take()
            if self.in_file and self.scopes[-1] != "async":
                self.fail("'await' outside async function")
            self.primary()
            out = ("await", ())
        else:
            out = self.primary()
        if self.skip_op("**"):
            self.unary()
            return ("operation", ())
        return out

    def primary(self):
        out = self.atom()
        while True:
            if self.skip_op("."):
                self.name()
                out = ("attribute", ())
            elif self.skip_op("("):
                self.arguments()
                out = ("call", ())
            elif self.skip_op("["):
                self.subscripts()
                out = ("item", ())
            else:
                return out

    def name(self) -> str:
        t = self.now
        if t.kind != "name" or t.text in KEYWORDS:
            self.fail("invalid syntax")
        return self.take().text

    def atom(self):
        t = self.now
        if t.kind == "name":
            if t.text in ("None", "True", "False"):
                self.take()
                return ("constant", (t.text,))
            return ("name", (self.name(),))
        if t.kind == "number":
            self.take()
            return ("literal", ())
        if t.kind in ("string", "fstring", "bytes"):
            kinds = set()
            while self.now.kind in ("string", "fstring", "bytes"):
                kinds.add(self.take().kind == "bytes")
            if len(kinds) > 1:
                self.fail("cannot mix bytes and nonbytes literals")
            return ("literal", ())
        if self.skip_op("..."):
            return ("ellipsis", ())
        if self.skip_op("("):
            return self.group(")")
        if self.skip_op("["):
            return self.group("]")
        if self.skip_op("{"):
            return self.braces()
        self.fail("invalid syntax")

    def group(self, close: str):
        kind = "tuple" if close == ")" else "list"
        if self.skip_op(close):
            return (kind, [])
        if close == ")" and self.is_word("yield"):
            self.yielded()
            self.need_op(")")
            return ("yield", ())
        first = self.star_expression()
        if self.is_word("for", "async"):
            if first[0] == "star":
                self.fail("iterable unpacking cannot be used in comprehension")
            self.comprehension()
            self.need_op(close)
            return ("comprehension", ())
        parts, comma = [first], False
        while self.skip_op(","):
            comma = True
            if self.is_op(close):
                break
            parts.append(self.star_expression())
        self.need_op(close)
        if close == ")" and not comma:
            if first[0] == "star":
                self.fail("cannot use starred expression here")
            return first if first[0] in ("name", "attribute", "item", "tuple", "list") else ("group", ())
        return (kind, parts)

    def braces(self):
        if self.skip_op("}"):
            return ("dict", ())
        is_dict = self.dict_item()
        if self.is_word("for", "async"):
            self.comprehension()
            self.need_op("}")
            return ("comprehension", ())
        while self.skip_op(","):
            if self.is_op("}"):
                break
            if self.dict_item() != is_dict:
                self.fail("invalid syntax")
        self.need_op("}")
        return ("dict" if is_dict else "set", ())

    def dict_item(self) -> bool:
        if self.skip_op("**"):
            self.binary(5)
            return True
        if self.is_op("*"):
            self.star_expression()
            return False
        self.named()
        if self.skip_op(":"):
            self.expression()
            return True
        return False

    def comprehension(self) -> None:
        while self.is_word("for", "async"):
            self.skip_word("async")
            self.need_word("for")
            self.targets()
            self.need_word("in")
            self.binary(1)
            while self.skip_word("if"):
                self.condition()

    def condition(self) -> None:
        """A condition of a comprehension: no bare 'if ... else'."""
        if self.now.kind == "name" and self.ahead().kind == "op" and self.ahead().text == ":=":
            self.named()
        else:
            self.binary(1)

    def targets(self) -> None:
        """Targets of 'for': they end before 'in'."""
        parts, comma = [], False
        while True:
            star = self.skip_op("*")
            parts.append(("star", (self.binary(5),)) if star else self.binary(5))
            if not self.skip_op(","):
                break
            comma = True
            if self.is_word("in"):
                break
        self.assignable(("tuple", parts) if comma else parts[0])

    def arguments(self) -> None:
        keyword = unpacked = False
        names: set[str] = set()
        count = 0
        while not self.is_op(")"):
            count += 1
            if self.skip_op("**"):
                self.expression()
                unpacked = True
            elif self.skip_op("*"):
                if unpacked:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.expression()
            elif self.now.kind == "name" and self.ahead().kind == "op" and self.ahead().text == "=":
                name = self.name()
                if name in names:
                    self.fail(f"keyword argument repeated: {name}")
                names.add(name)
                self.take()
                self.expression()
                keyword = True
            else:
                self.named()
                if self.is_word("for", "async"):
                    self.comprehension()
                    if count > 1 or self.is_op(",") and not (self.ahead().kind == "op" and self.ahead().text == ")"):
                        self.fail("Generator expression must be parenthesized")
                if keyword or unpacked:
                    self.fail("positional argument follows keyword argument")
            if not self.skip_op(","):
                break
        self.need_op(")")

    def subscripts(self) -> None:
        if self.is_op("]"):
            self.fail("invalid syntax")
        while not self.is_op("]"):
            if self.is_op("*"):
                self.star_expression()
            else:
                if not self.is_op(":"):
                    self.named()
                if self.skip_op(":"):
                    if not self.is_op(":", ",", "]"):
                        self.expression()
                    if self.skip_op(":") and not self.is_op(",", "]"):
                        self.expression()
            if not self.skip_op(","):
                break
        self.need_op("]")

    def assignable(self, e, alone: bool = True) -> None:
        kind, parts = e
        if kind in ("attribute", "item"):
            return
        if kind == "name":
            if parts[0] == "__debug__":
                self.fail("cannot assign to __debug__")
            return
        if kind in ("tuple", "list"):
            if sum(p[0] == "star" for p in parts) > 1:
                self.fail("multiple starred expressions in assignment")
            for p in parts:
                self.assignable(p[1][0] if p[0] == "star" else p)
            return
        if kind == "star" and not alone:
            return self.assignable(parts[0])
        self.fail(f"cannot assign to {kind}")

    # -- statements

    def file(self) -> None:
        self.in_file = True
        while self.now.kind != "end":
            if self.now.kind == "dedent":
                self.take()
                continue
            self.statement()

    def recover(self, e: Fault) -> None:
        """Panic mode: to the end of the line, and over the block that may follow it."""
        self.note(e)
        while self.now.kind not in ("newline", "end"):
            self.take()
        if self.now.kind == "newline":
            self.take()
        if self.now.kind == "indent":
            self.take()
            while self.now.kind not in ("dedent", "end"):
                self.statement()
            if self.now.kind == "dedent":
                self.take()

    def statement(self) -> None:
        depth = len(self.scopes), len(self.loops)
        try:
            self.one_statement()
        except Fault as e:
            del self.scopes[depth[0] :], self.loops[depth[1] :]
            self.recover(e)

    def one_statement(self) -> None:
        t = self.now
        if t.kind == "indent":
            raise Fault(t.line, "unexpected indent")
        if self.is_op("@"):
            while self.skip_op("@"):
                self.named()
                self.line_end()
            if not self.is_word("def", "class", "async"):
                self.fail("expected a definition after a decorator")
            t = self.now
        word = t.text if t.kind == "name" else ""
        compound = getattr(self, f"{word}_block", None) if word in BLOCKS else None
        if compound:
            self.docs = False
            self.take()
            compound()
        elif word in ("match", "type") and self.soft(word):
            return
        else:
            self.simple_line()

    def soft(self, word: str) -> bool:
        """'match' and 'type' are keywords only if the statement can be read so."""
        start = self.i
        nxt = self.ahead()
        if word == "type":
            if nxt.kind == "name" and nxt.text not in KEYWORDS:
                self.take()
                self.take()
                self.type_parameters()
                self.need_op("=")
                self.expression()
                self.line_end()
                return True
            return False
        if nxt.kind in ("newline", "end") or (nxt.kind == "op" and nxt.text not in ("(", "[", "{", "-", "*", "~", "...")):
            return False
        self.take()
        try:
            self.star_expressions()
            if not (self.is_op(":") and self.ahead().kind == "newline"):
                raise Fault(self.now.line, "")
        except Fault:
            self.i = start
            return False
        self.take()
        self.take()
        if self.now.kind != "indent":
            self.fail("expected an indented block after 'match' statement")
        self.take()
        while self.now.kind not in ("dedent", "end"):
            self.need_word("case")
            self.pattern(True)
            if self.skip_word("if"):
                self.named()
            self.block("case")
        if self.now.kind == "dedent":
            self.take()
        return True

    def pattern(self, top: bool = False) -> None:
        while True:
            if self.skip_op("*"):
                self.name()
            else:
                self.one_pattern()
                while self.skip_op("|"):
                    self.one_pattern()
                if self.skip_word("as"):
                    self.name()
            if not (top and self.skip_op(",")) or self.is_op(":") or self.is_word("if"):
                return

    def one_pattern(self) -> None:
        if self.is_op("(", "["):
            close = ")" if self.take().text == "(" else "]"
            while not self.is_op(close):
                self.pattern()
                if not self.skip_op(","):
                    break
            self.need_op(close)
        elif self.skip_op("{"):
            while not self.is_op("}"):
                if self.skip_op("**"):
                    self.name()
                else:
                    self.binary(9)
                    self.need_op(":")
                    self.pattern()
                if not self.skip_op(","):
                    break
            self.need_op("}")
        elif self.now.kind == "name" and self.now.text not in KEYWORDS:
            self.name()
            while self.skip_op("."):
                self.name()
            if self.skip_op("("):
                while not self.is_op(")"):
                    if self.now.kind == "name" and self.ahead().kind == "op" and self.ahead().text == "=":
                        self.take()
                        self.take()
                    self.pattern()
                    if not self.skip_op(","):
                        break
                self.need_op(")")
        elif self.now.kind in ("number", "string", "bytes", "fstring") or self.is_op("-") or self.is_word("None", "True", "False"):
            self.binary(9)
        else:
            self.fail("invalid pattern")

    def line_end(self) -> None:
        if self.now.kind != "newline":
            self.fail("invalid syntax")
        self.take()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.skip_op(";") or self.now.kind == "newline":
                break
        self.line_end()

    def simple(self) -> None:
        t = self.now
        word = t.text if t.kind == "name" else ""
        rule = getattr(self, f"{word}_line", None) if word in LINES else None
        if word != "from" and not (t.kind == "string"):
            self.docs = False
        if rule:
            self.take()
            rule()
            return
        if word in KEYWORDS and word not in ("None", "True", "False", "not", "lambda", "await", "yield"):
            self.fail("invalid syntax")
        left = self.star_or_yield()
        if self.is_op("="):
            targets = [left]
            while self.skip_op("="):
                targets.append(self.star_or_yield())
            for e in targets[:-1]:
                self.assignable(e)
            if targets[-1][0] == "star":
                self.fail("can't use starred expression here")
        elif self.is_op(*ASSIGN):
            if left[0] not in ("name", "attribute", "item"):
                self.fail(f"'{left[0]}' is an illegal expression for augmented assignment")
            self.take()
            self.star_or_yield()
        elif self.is_op(":"):
            if left[0] not in ("name", "attribute", "item"):
                self.fail("illegal target for annotation")
            self.take()
            self.expression()
            if self.skip_op("="):
                self.star_or_yield()
        elif left[0] == "star":
            self.fail("can't use starred expression here")

    def pass_line(self) -> None:
        pass

    def break_line(self) -> None:
        if not self.loops[-1]:
            self.fail("'break' outside loop")

    def continue_line(self) -> None:
        if not self.loops[-1]:
            self.fail("'continue' not properly in loop")

    def return_line(self) -> None:
        if self.scopes[-1] not in ("function", "async"):
            self.fail("'return' outside function")
        if self.now.kind != "newline" and not self.is_op(";"):
            self.star_expressions()

    def raise_line(self) -> None:
        if self.now.kind != "newline" and not self.is_op(";"):
            self.expression()
            if self.skip_word("from"):
                self.expression()

    def global_line(self) -> None:
        self.name()
        while self.skip_op(","):
            self.name()

    def nonlocal_line(self) -> None:
        if self.scopes[-1] == "module":
            self.fail("nonlocal declaration not allowed at module level")
        self.global_line()

    def del_line(self) -> None:
        e = self.star_expressions()
        for p in e[1] if e[0] in ("tuple", "list") else [e]:
            if p[0] == "star":
                self.fail("cannot delete starred")
            self.assignable(p)

    def assert_line(self) -> None:
        self.expression()
        if self.skip_op(","):
            self.expression()

    def dotted(self) -> str:
        out = self.name()
        while self.skip_op("."):
            out += "." + self.name()
        return out

    def import_line(self) -> None:
        while True:
            self.dotted()
            if self.skip_word("as"):
                self.name()
            if not self.skip_op(","):
                return

    def from_line(self) -> None:
        dots = False
        while self.is_op(".", "..."):
            self.take()
            dots = True
        module = "" if dots and self.is_word("import") else self.dotted()
        self.need_word("import")
        future = module == "__future__" and not dots
        if future and not self.docs:
            self.fail("from __future__ imports must occur at the beginning of the file")
        self.docs &= future
        if self.skip_op("*"):
            if self.scopes[-1] != "module":
                self.fail("import * only allowed at module level")
            return
        group = self.skip_op("(")
        while True:
            name = self.name()
            if future and name not in FEATURES:
                self.fail(f"future feature {name} is not defined")
            if self.skip_word("as"):
                self.name()
            if not self.skip_op(","):
                break
            if group and self.is_op(")"):
                break
        if group:
            self.need_op(")")

    # -- blocks

    def block(self, what: str) -> None:
        self.need_op(":")
        if self.now.kind != "newline":
            self.simple_line()
            return
        self.take()
        if self.now.kind != "indent":
            self.fail(f"expected an indented block after {what}")
        self.take()
        while self.now.kind not in ("dedent", "end"):
            self.statement()
        if self.now.kind == "dedent":
            self.take()

    def loop(self, what: str) -> None:
        self.loops[-1] += 1
        self.block(what)
        self.loops[-1] -= 1
        if self.skip_word("else"):
            self.block("'else' statement")

    def if_block(self) -> None:
        self.named()
        self.block("'if' statement")
        while self.skip_word("elif"):
            self.named()
            self.block("'elif' statement")
        if self.skip_word("else"):
            self.block("'else' statement")

    def while_block(self) -> None:
        self.named()
        self.loop("'while' statement")

    def for_block(self) -> None:
        self.targets()
        self.need_word("in")
        self.star_expressions()
        self.loop("'for' statement")

    def with_block(self) -> None:
        start = self.i
        if self.skip_op("("):  # items in brackets, if the colon follows them
            try:
                self.with_items(")")
                self.need_op(")")
                if not self.is_op(":"):
                    raise Fault(0, "")
            except Fault:
                self.i = start
                self.with_items("")
        else:
            self.with_items("")
        self.block("'with' statement")

    def with_items(self, close: str) -> None:
        while True:
            self.expression()
            if self.skip_word("as"):
                star = self.star_expression() if close else self.binary(5)
                self.assignable(star)
            if not self.skip_op(",") or (close and self.is_op(close)):
                return

    def try_block(self) -> None:
        self.block("'try' statement")
        handlers, bare, group = 0, False, None
        while self.skip_word("except"):
            if bare:
                self.fail("default 'except:' must be last")
            star = self.skip_op("*")
            if group not in (None, star):
                self.fail("cannot have both 'except' and 'except*'")
            group = star
            handlers += 1
            if self.is_op(":"):
                bare = True
                if star:
                    self.fail("expected one or more exception types")
            else:
                self.expression()
                if self.is_op(","):
                    self.fail("multiple exception types must be parenthesized")
                if self.skip_word("as"):
                    self.name()
            self.block("'except' statement")
        if handlers and self.skip_word("else"):
            self.block("'else' statement")
        if self.skip_word("finally"):
            self.block("'finally' statement")
        elif not handlers:
            self.fail("expected 'except' or 'finally' block")

    def async_block(self) -> None:
        if self.skip_word("def"):
            self.function("async")
            return
        if not self.is_word("for", "with"):
            self.fail("invalid syntax")
        if self.scopes[-1] != "async":
            self.fail("'async' outside async function")
        self.for_block() if self.take().text == "for" else self.with_block()

    def def_block(self) -> None:
        self.function("function")

    def function(self, scope: str) -> None:
        self.name()
        self.type_parameters()
        self.need_op("(")
        self.parameters(")", True)
        self.need_op(")")
        if self.skip_op("->"):
            self.expression()
        self.inside(scope, "function definition")

    def inside(self, scope: str, what: str) -> None:
        self.scopes.append(scope)
        self.loops.append(0)
        self.block(what)
        self.scopes.pop()
        self.loops.pop()

    def class_block(self) -> None:
        self.name()
        self.type_parameters()
        if self.skip_op("("):
            self.arguments()
        self.inside("class", "class definition")

    def type_parameters(self) -> None:
        if self.skip_op("["):
            while not self.is_op("]"):
                if not self.skip_op("**"):
                    self.skip_op("*")
                self.name()
                if self.skip_op(":"):
                    self.expression()
                if self.skip_op("="):
                    self.star_expression()
                if not self.skip_op(","):
                    break
            self.need_op("]")

    def parameters(self, close: str, annotated: bool) -> None:
        names: set[str] = set()
        default = star = slash = False
        bare = False

        def one() -> None:
            name = self.name()
            if name in names:
                self.fail(f"duplicate argument '{name}' in function definition")
            names.add(name)

        while not self.is_op(close):
            if self.skip_op("**"):
                one()
                if annotated and self.skip_op(":"):
                    self.expression()
                self.skip_op(",")
                if not self.is_op(close):
                    self.fail("arguments cannot follow var-keyword argument")
                break
            if self.skip_op("/"):
                if slash or star or not names:
                    self.fail("invalid '/' in parameters")
                slash = True
            elif self.skip_op("*"):
                if star:
                    self.fail("* argument may appear only once")
                star = True
                if self.is_op(","):
                    bare = True
                else:
                    one()
                    if annotated and self.skip_op(":"):
                        self.star_expression()
            else:
                one()
                bare = False
                if annotated and self.skip_op(":"):
                    self.expression()
                if self.skip_op("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            if not self.skip_op(","):
                break
        if bare:
            self.fail("named arguments must follow bare *")


BLOCKS = frozenset("if while for with try async def class".split())
#: Fixed value: the compiler's limit.
MAX_BRACKETS = 200
LINES = frozenset("pass break continue return raise global nonlocal del assert import from".split())


def errors(text: str) -> list[tuple[int, str]]:
    """Errors of a file, by line; line ends of any kind count alike."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    lexer = Lexer(text)
    if "\0" in text:
        lexer.note("source code cannot contain null bytes")
    p = Parser(lexer.run())
    p.file()
    return sorted(lexer.found + p.found, key=lambda e: e[0])
