"""Java 17, syntax only: recursive-descent declarations and statements, precedence-climbing expressions, panic-mode recovery."""

from __future__ import annotations

import regex

from loomgraph.llm.syntax.base import Cursor, Fault, Token

KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while _ true false null".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset(
    "public protected private static abstract final native synchronized transient volatile strictfp default".split()
)
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
POWER = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7,
    "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
LITERALS = ("number", "string", "char")

_escape = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
_digits = r"[0-9](?:_*[0-9])*"
_hex = r"[0-9a-fA-F](?:_*[0-9a-fA-F])*"
_token = regex.compile(
    r"(?P<blank>[ \t\f\n\r\x1a]+|//[^\n\r]*|/\*(?s:.*?)\*/)"
    rf"|(?P<text>\"\"\"[ \t\f]*(?:\r\n|\r|\n)(?:[^\\\"]|\\(?:\r\n|[\s\S])|\"(?!\"\"))*+\"\"\")"
    rf"|(?P<string>\"(?!\"\")(?:[^\"\\\n\r]|{_escape})*+\"|\"\"(?!\"))"
    rf"|(?P<char>'(?:[^'\\\n\r]|{_escape})')"
    rf"|(?P<number>0[xX](?:{_hex})?\.?(?:{_hex})?[pP][+-]?{_digits}[fFdD]?|0[xX]{_hex}[lL]?|0[bB][01](?:_*[01])*[lL]?"
    rf"|(?:{_digits}\.(?:{_digits})?|\.{_digits}|{_digits})(?:[eE][+-]?{_digits})?[lLfFdD]?)"
    r"|(?P<name>[\p{L}_$\p{Sc}\p{Nl}\p{Pc}][\p{L}\p{N}\p{Mn}\p{Mc}_$\p{Sc}\p{Pc}]*)"
    r"|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[-+*/%&|^!~<>=?:;,.@(){}\[\]])"
    r"|(?P<bad>\"[^\n\r]*|'[^\n\r]*|/\*(?s:.*)|.)",
    regex.S,
)


def _tokens(text: str) -> tuple[list[Token], list[tuple[int, str]]]:
    out, found, line = [], [], 1
    for m in _token.finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "bad":
            found.append((line, f"illegal text {s[:20]!r}"))
        elif kind != "blank":
            if kind == "number" and out and out[-1].kind == "number" and out[-1].at + len(out[-1].text) == m.start():
                found.append((line, "malformed number"))
            if kind == "name" and out and out[-1].kind == "number" and out[-1].at + len(out[-1].text) == m.start():
                found.append((line, "malformed number"))
            if kind == "number" and regex.fullmatch(r"0[0-9_]*[89][0-9_]*[lL]?", s):
                found.append((line, "integer number is not octal"))
            out.append(Token("string" if kind == "text" else kind, s, line, m.start()))
        line += s.count("\n") + s.count("\r") - s.count("\r\n")
    return [*out, Token("end", "", line, len(text))], found


class Parser(Cursor):
    # -- helpers

    def adjacent(self, n: int) -> bool:
        """Whether token n ahead touches the one before it."""
        a, b = self.ahead(n - 1), self.ahead(n)
        return b.kind == "op" and a.at + len(a.text) == b.at

    def operator(self) -> tuple[str, int]:
        """The operator here and its number of tokens; '>' are single tokens, so that type arguments can close."""
        t = self.now
        if t.kind != "op" or t.text != ">":
            return t.text, 1
        text, n = ">", 1
        while n < 3 and self.adjacent(n) and self.ahead(n).text == ">":
            text, n = text + ">", n + 1
        if self.adjacent(n) and self.ahead(n).text in ("=", "=="):
            return (text + "=", n + 1) if self.ahead(n).text == "=" else (text, n)
        return text, n

    def attempt(self, rule) -> bool:
        start = self.i
        try:
            rule()
            return True
        except Fault:
            self.i = start
            return False

    def name(self) -> str:
        t = self.now
        if t.kind != "name" or t.text in KEYWORDS:
            self.fail("expected an identifier")
        return self.take().text

    def is_name(self, n: int = 0) -> bool:
        t = self.ahead(n) if n else self.now
        return t.kind == "name" and t.text not in KEYWORDS

    def qualified(self) -> None:
        self.name()
        while self.is_op(".") and self.is_name(1):
            self.take()
            self.take()

    def recover(self, e: Fault, start: int) -> None:
        """Panic mode: past the next ';' or block of this level, or up to the brace that closes it."""
        self.note(e)
        depth = 0
        if self.i == start and not self.is_op("}"):
            depth += self.is_op("{")
            if self.take().text == ";":
                return
        while self.now.kind != "end":
            if self.is_op("{"):
                depth += 1
            elif self.is_op("}"):
                if depth == 0:
                    return
                depth -= 1
                if depth == 0:
                    self.take()
                    return
            elif self.is_op(";") and depth == 0:
                self.take()
                return
            self.take()

    # -- types

    def annotations(self) -> None:
        while self.is_op("@") and not (self.ahead().kind == "name" and self.ahead().text == "interface"):
            self.take()
            self.qualified()
            if self.skip_op("("):
                if not self.is_op(")"):
                    while True:
                        if self.is_name() and self.ahead().kind == "op" and self.ahead().text == "=":
                            self.take()
                            self.take()
                        self.element()
                        if not self.skip_op(","):
                            break
                self.need_op(")")

    def element(self) -> None:
        if self.is_op("@"):
            self.annotations()
        elif self.skip_op("{"):
            while not self.is_op("}"):
                self.element()
                if not self.skip_op(","):
                    break
            self.need_op("}")
        else:
            self.ternary()

    def dims(self) -> int:
        n = 0
        while True:
            start = self.i
            self.annotations()
            if not (self.is_op("[") and self.ahead().kind == "op" and self.ahead().text == "]"):
                self.i = start
                return n
            self.take()
            self.take()
            n += 1

    def type(self, dims: bool = True) -> None:
        self.annotations()
        if self.now.kind == "name" and self.now.text in PRIMITIVES:
            self.take()
        else:
            self.name()
            self.type_arguments()
            while self.is_op(".") and (self.is_name(1) or self.ahead().text == "@"):
                self.take()
                self.annotations()
                self.name()
                self.type_arguments()
        if dims:
            self.dims()

    def type_arguments(self) -> None:
        if not self.skip_op("<"):
            return
        if self.skip_op(">"):
            return
        while True:
            self.annotations()
            if self.skip_op("?"):
                if self.skip_word("extends") or self.skip_word("super"):
                    self.type()
            else:
                self.type()
            if not self.skip_op(","):
                break
        self.need_op(">")

    def type_parameters(self) -> None:
        if self.skip_op("<"):
            while True:
                self.annotations()
                self.name()
                if self.skip_word("extends"):
                    self.type()
                    while self.skip_op("&"):
                        self.type()
                if not self.skip_op(","):
                    break
            self.need_op(">")

    def types(self) -> None:
        self.type()
        while self.skip_op(","):
            self.type()

    # -- declarations

    def file(self) -> None:
        start = self.i
        try:
            self.annotations()
            if self.skip_word("package"):
                self.qualified()
                self.need_op(";")
            else:
                self.i = start
        except Fault as e:
            self.recover(e, start)
        types = False
        while self.now.kind != "end":
            start = self.i
            try:
                if self.skip_op(";"):
                    continue
                if self.is_word("import"):
                    if types:
                        self.fail("import after a type")
                    self.import_()
                else:
                    self.type_declaration()
                    types = True
            except Fault as e:
                self.recover(e, start)
                if self.is_op("}"):
                    self.take()

    def import_(self) -> None:
        self.need_word("import")
        self.skip_word("static")
        self.name()
        while self.skip_op("."):
            if self.skip_op("*"):
                break
            self.name()
        self.need_op(";")

    def modifiers(self) -> set[str]:
        seen: set[str] = set()
        while True:
            self.annotations()
            t = self.now
            if t.kind != "name":
                return seen
            nxt = self.ahead()
            if t.text == "non" and nxt.text == "-" and self.ahead(2).text == "sealed":
                self.take()
                self.take()
                word = "non-sealed"
            elif t.text == "sealed" and nxt.kind == "name":
                word = "sealed"
            elif t.text in MODIFIERS and not (t.text == "default" and nxt.text in (":", "->")):
                word = t.text
            else:
                return seen
            if word in seen:
                self.fail("repeated modifier")
            seen.add(word)
            self.take()

    def at_type(self) -> bool:
        t, nxt = self.now, self.ahead()
        return (
            (t.kind == "name" and t.text in ("class", "interface", "enum"))
            or (t.kind == "op" and t.text == "@" and nxt.kind == "name" and nxt.text == "interface")
            or (t.kind == "name" and t.text == "record" and self.is_name(1) and self.ahead(2).text in ("(", "<"))
        )

    def type_declaration(self) -> None:
        self.modifiers()
        if not self.at_type():
            self.fail("expected class, interface, enum or record")
        self.type_rest()

    def type_rest(self) -> None:
        if self.skip_op("@"):
            self.need_word("interface")
            kind = "interface"
        else:
            kind = self.take().text
        name = self.name()
        self.type_parameters()
        if kind == "record":
            self.need_op("(")
            self.parameters()
        if self.skip_word("extends"):
            self.types() if kind == "interface" else self.type()
        if self.skip_word("implements"):
            self.types()
        if self.is_word("permits"):
            self.take()
            self.types()
        self.body(name, kind)

    def body(self, name: str, kind: str) -> None:
        self.need_op("{")
        if kind == "enum":
            self.constants()
        while not self.is_op("}"):
            if self.now.kind == "end":
                self.fail("reached end of file while parsing")
            start = self.i
            try:
                self.member(name, kind)
            except Fault as e:
                self.recover(e, start)
        self.take()

    def constants(self) -> None:
        while not self.is_op(";", "}"):
            self.annotations()
            self.name()
            if self.skip_op("("):
                self.arguments()
            if self.is_op("{"):
                self.body("", "class")
            if not self.skip_op(","):
                break
        if not self.is_op("}"):
            self.need_op(";")

    def member(self, owner: str, kind: str) -> None:
        if self.skip_op(";"):
            return
        if self.is_op("{") or (self.is_word("static") and self.ahead().text == "{"):
            self.skip_word("static")
            self.block()
            return
        self.modifiers()
        if self.at_type():
            self.type_rest()
            return
        self.type_parameters()
        self.annotations()
        if self.is_name() and self.ahead().text == "(" and self.ahead().kind == "op":
            if self.now.text != owner:
                self.fail("invalid method declaration; return type required")
            self.take()
            self.take()
            self.parameters()
            self.method_rest(False)
            return
        if kind == "record" and self.is_word(owner) and self.ahead().text == "{":
            self.take()
            self.block()
            return
        if not self.skip_word("void"):
            self.type()
        elif not self.is_name():
            self.fail("expected an identifier")
        self.name()
        if self.skip_op("("):
            self.parameters()
            self.dims()
            self.method_rest(True)
        else:
            self.declarators()
            self.need_op(";")

    def method_rest(self, may_default: bool) -> None:
        if self.skip_word("throws"):
            self.types()
        if may_default and self.skip_word("default"):
            self.element()
        if not self.skip_op(";"):
            self.block()

    def parameters(self) -> None:
        """After the opening bracket, to the closing one."""
        while not self.is_op(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.skip_op("...")
            if not self.skip_word("this"):
                self.name()
                if self.skip_op("."):
                    self.need_word("this")
            self.dims()
            if not self.skip_op(","):
                break
            if self.is_op(")"):
                self.fail("expected a parameter")
        self.need_op(")")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.skip_op("="):
                self.initializer()
            if not self.skip_op(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.skip_op("{"):
            while not self.is_op("}"):
                self.initializer()
                if not self.skip_op(","):
                    break
            self.need_op("}")
        else:
            self.expression()

    # -- statements

    def block(self) -> None:
        self.need_op("{")
        self.statements()
        self.need_op("}")

    def statements(self, switch: bool = False) -> None:
        while not self.is_op("}"):
            if self.now.kind == "end":
                self.fail("reached end of file while parsing")
            if switch and self.at_label():
                return
            start = self.i
            try:
                self.block_statement()
            except Fault as e:
                self.recover(e, start)

    def at_label(self) -> bool:
        return self.is_word("case") or (self.is_word("default") and self.ahead().text in (":", "->"))

    def block_statement(self) -> None:
        t = self.now
        if t.kind == "name" and (t.text in ("final", "abstract", "strictfp", "static", "sealed", "non") or self.at_type()) or t.text == "@":
            start = self.i
            self.modifiers()
            if self.at_type():
                self.type_rest()
                return
            if self.i > start:
                self.type()
                self.name()
                self.declarators()
                self.need_op(";")
                return
        if self.local_variable():
            return
        self.statement()

    def local_variable(self) -> bool:
        t = self.now
        if t.kind != "name" or (t.text in KEYWORDS and t.text not in PRIMITIVES):
            return False
        start = self.i

        def head() -> None:
            self.type()
            self.name()
            if not (self.is_op("=", ",", ";", "[") or self.now.kind == "end"):
                self.fail("expected ';'")

        if t.text == "yield" and not self.is_name(1):
            return False
        if not self.attempt(head):
            if t.text in PRIMITIVES and self.ahead().text not in (".", "[", "::"):
                self.type()
                self.name()
                self.fail("expected ';'")
            return False
        if t.text == "yield":
            self.i = start
            return False
        self.declarators()
        self.need_op(";")
        return True

    def condition(self) -> None:
        self.need_op("(")
        self.expression()
        self.need_op(")")

    def statement(self) -> None:
        t = self.now
        word = t.text if t.kind == "name" else ""
        rule = getattr(self, f"{word}_statement", None) if word in STATEMENTS else None
        if rule:
            self.take()
            rule()
        elif self.is_op("{"):
            self.block()
        elif self.skip_op(";"):
            pass
        elif self.is_name() and self.ahead().kind == "op" and self.ahead().text == ":":
            self.take()
            self.take()
            self.statement()
        elif word == "yield" and self.ahead().text not in ("=", ".", "[", "++", "--", ")", ";"):
            self.take()
            self.expression()
            self.need_op(";")
        elif word == "switch":
            self.switch()
            if self.is_op("."):
                self.fail("not a statement")
        else:
            kind = self.expression()
            if kind not in ("assign", "call", "new", "step"):
                raise Fault(t.line, "not a statement")
            self.need_op(";")

    def if_statement(self) -> None:
        self.condition()
        self.statement()
        if self.skip_word("else"):
            self.statement()

    def while_statement(self) -> None:
        self.condition()
        self.statement()

    def do_statement(self) -> None:
        self.statement()
        self.need_word("while")
        self.condition()
        self.need_op(";")

    def for_statement(self) -> None:
        self.need_op("(")

        def each() -> None:
            self.modifiers()
            self.type()
            self.name()
            self.dims()
            self.need_op(":")

        if self.attempt(each):
            self.expression()
        else:
            if not self.is_op(";"):
                start = self.i

                def declared() -> None:
                    self.modifiers()
                    self.type()
                    self.name()
                    if not self.is_op("=", ",", ";", "["):
                        self.fail("")

                if self.attempt(declared):
                    self.declarators()
                else:
                    self.i = start
                    self.expressions()
            self.need_op(";")
            if not self.is_op(";"):
                self.expression()
            self.need_op(";")
            if not self.is_op(")"):
                self.expressions()
        self.need_op(")")
        self.statement()

    def expressions(self) -> None:
        while True:
            if self.expression() not in ("assign", "call", "new", "step"):
                self.fail("not a statement")
            if not self.skip_op(","):
                return

    def try_statement(self) -> None:
        resources = self.skip_op("(")
        if resources:
            while not self.is_op(")"):

                def declared() -> None:
                    self.modifiers()
                    self.type()
                    self.name()
                    self.need_op("=")

                self.attempt(declared)
                self.expression()
                if not self.skip_op(";"):
                    break
            self.need_op(")")
        self.block()
        handled = resources
        while self.skip_word("catch"):
            handled = True
            self.need_op("(")
            self.modifiers()
            self.type()
            while self.skip_op("|"):
                self.type()
            self.name()
            self.need_op(")")
            self.block()
        if self.skip_word("finally"):
            self.block()
        elif not handled:
            self.fail("'try' without 'catch', 'finally' or resource declarations")

    def synchronized_statement(self) -> None:
        self.condition()
        self.block()

    def return_statement(self) -> None:
        if not self.is_op(";"):
            self.expression()
        self.need_op(";")

    def throw_statement(self) -> None:
        self.expression()
        self.need_op(";")

    def break_statement(self) -> None:
        if self.is_name():
            self.take()
        self.need_op(";")

    continue_statement = break_statement

    def assert_statement(self) -> None:
        self.expression()
        if self.skip_op(":"):
            self.expression()
        self.need_op(";")

    def switch(self) -> None:
        self.need_word("switch")
        self.condition()
        self.need_op("{")
        while not self.is_op("}"):
            if not self.at_label():
                self.fail("expected case, default or '}'")
            if self.take().text == "case":
                while True:
                    self.ternary()
                    if not self.skip_op(","):
                        break
            if self.skip_op("->"):
                if self.is_op("{"):
                    self.block()
                elif self.skip_word("throw"):
                    self.throw_statement()
                else:
                    self.expression()
                    self.need_op(";")
            else:
                self.need_op(":")
                self.statements(True)
        self.take()

    # -- expressions; each gives its kind

    def expression(self) -> str:
        if self.at_lambda():
            self.lambda_()
            return "lambda"
        start = self.now
        kind = self.ternary()
        op, n = self.operator()
        if self.now.kind == "op" and op in ASSIGN:
            if kind not in ("name", "field", "item"):
                raise Fault(start.line, "unexpected type: a variable is required")
            self.i += n
            self.expression()
            return "assign"
        return kind

    def at_lambda(self) -> bool:
        if self.is_name():
            return self.ahead().kind == "op" and self.ahead().text == "->"
        if not self.is_op("("):
            return False
        depth, n = 0, 0
        while True:
            t = self.ahead(n) if n else self.now
            if t.kind == "end":
                return False
            if t.kind == "op":
                depth += (t.text == "(") - (t.text == ")")
                if depth == 0:
                    return self.ahead(n + 1).text == "->"
                if t.text in (";", "{", "}"):
                    return False
            n += 1

    def lambda_(self) -> None:
        if self.is_name():
            self.take()
        else:
            self.take()
            if self.is_name() and self.ahead().text in (",", ")"):
                self.name()
                while self.skip_op(","):
                    self.name()
                self.need_op(")")
            else:
                self.parameters()
        self.need_op("->")
        self.block() if self.is_op("{") else self.expression()

    def ternary(self) -> str:
        kind = self.binary(1)
        if self.skip_op("?"):
            self.expression()
            self.need_op(":")
            self.lambda_() if self.at_lambda() else self.ternary()
            return "ternary"
        return kind

    def binary(self, least: int) -> str:
        """Precedence climbing; all binary operators group to the left."""
        kind = self.unary()
        while True:
            op, n = self.operator()
            power = POWER.get(op) if self.now.kind in ("op", "name") else None
            if power is None or power < least:
                return kind
            self.i += n
            if op == "instanceof":
                self.modifiers()
                self.type()
                if self.is_name():
                    self.take()
            else:
                self.binary(power + 1)
            kind = "operation"

    def unary(self) -> str:
        if self.is_op("++", "--"):
            self.take()
            if self.unary() not in ("name", "field", "item"):
                self.fail("unexpected type: a variable is required")
            return "step"
        if self.is_op("+", "-", "!", "~"):
            self.take()
            self.unary()
            return "operation"
        if self.is_op("(") and self.attempt(self.cast):
            return "cast"
        return self.postfix(self.primary())

    def cast(self) -> None:
        self.need_op("(")
        primitive = self.now.kind == "name" and self.now.text in PRIMITIVES
        self.type()
        while self.skip_op("&"):
            self.type()
        self.need_op(")")
        if self.tokens[self.i - 2].text == "]":
            primitive = False
        if self.at_lambda():
            self.lambda_()
            return
        t = self.now
        starts = t.kind in LITERALS or self.is_op("(", "!", "~") or (
            t.kind == "name" and (t.text not in KEYWORDS or t.text in ("this", "super", "new", "switch", "true", "false", "null", "void") or t.text in PRIMITIVES)
        )
        if not starts and not (primitive and self.is_op("+", "-", "++", "--")):
            self.fail("not a cast")
        self.unary()

    def arguments(self) -> None:
        """After the opening bracket, to the closing one."""
        if not self.is_op(")"):
            self.expression()
            while self.skip_op(","):
                self.expression()
        self.need_op(")")

    def primary(self) -> str:
        t = self.now
        if t.kind in LITERALS:
            self.take()
            return "literal"
        if t.kind == "name":
            if t.text in ("true", "false", "null"):
                self.take()
                return "literal"
            if t.text in ("this", "super"):
                self.take()
                if self.skip_op("("):
                    self.arguments()
                    return "call"
                if t.text == "super" and not self.is_op(".", "::"):
                    self.fail("expected '.'")
                return "this"
            if t.text == "new":
                return self.new()
            if t.text == "switch":
                self.switch()
                return "switch"
            if t.text in PRIMITIVES or t.text == "void":
                self.take()
                if t.text != "void":
                    self.dims()
                if self.is_op("::"):
                    return "type"
                self.need_op(".")
                self.need_word("class")
                return "literal"
            if t.text not in KEYWORDS:
                start = self.i
                if self.ahead().text in ("<", "[", ".") and self.attempt(self.type) and self.is_op("::"):
                    return "type"
                if self.is_op(".") and self.ahead().text == "class" and self.tokens[self.i - 1].text == "]":
                    self.take()
                    self.take()
                    return "literal"
                self.i = start
                self.take()
                if self.skip_op("("):
                    self.arguments()
                    return "call"
                return "name"
        if self.skip_op("("):
            kind = self.expression()
            self.need_op(")")
            return kind if kind in ("name", "field", "item") else "group"
        self.fail("illegal start of expression")

    def postfix(self, kind: str) -> str:
        while True:
            if self.skip_op("."):
                if self.skip_word("class") or self.skip_word("this"):
                    kind = "literal"
                elif self.is_word("new"):
                    kind = self.new()
                elif self.skip_word("super"):
                    if self.skip_op("("):
                        self.arguments()
                        kind = "call"
                    elif not self.is_op(".", "::"):
                        self.fail("expected '.'")
                else:
                    generic = self.is_op("<")
                    self.type_arguments()
                    if generic and self.skip_word("super"):
                        pass
                    else:
                        self.name()
                    if self.skip_op("("):
                        self.arguments()
                        kind = "call"
                    elif generic:
                        self.fail("expected '('")
                    else:
                        kind = "field"
            elif self.is_op("["):
                self.take()
                self.expression()
                self.need_op("]")
                kind = "item"
            elif self.skip_op("::"):
                self.type_arguments()
                if not self.skip_word("new"):
                    self.name()
                kind = "reference"
            elif self.is_op("++", "--"):
                if kind not in ("name", "field", "item"):
                    self.fail("unexpected type: a variable is required")
                self.take()
                kind = "step"
            else:
                return kind

    def new(self) -> str:
        self.need_word("new")
        self.type_arguments()
        self.annotations()
        self.type(dims=False)
        if self.is_op("[") or self.is_op("@"):
            sized = False
            while self.is_op("[", "@"):
                self.annotations()
                self.need_op("[")
                if not self.is_op("]"):
                    self.expression()
                    sized = True
                self.need_op("]")
            if self.is_op("{"):
                if sized:
                    self.fail("array creation with both dimension expression and initialization")
                self.initializer()
            elif not sized:
                self.fail("array dimension missing")
            return "array"
        self.need_op("(")
        self.arguments()
        if self.is_op("{"):
            self.body("", "class")
        return "new"


STATEMENTS = frozenset("if while do for try synchronized return throw break continue assert".split())


def errors(text: str) -> list[tuple[int, str]]:
    tokens, found = _tokens(text.removeprefix("\ufeff"))
    p = Parser(tokens)
    p.file()
    return sorted(found + p.found, key=lambda e: e[0])
