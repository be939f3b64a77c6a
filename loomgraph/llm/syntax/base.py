"""What the parsers share: tokens, the error that starts a recovery, and a cursor."""

from __future__ import annotations

from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    at: int


class Fault(Exception):
    """An error at a line; raised to unwind to the next point of recovery."""

    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line, self.message = line, message


class Cursor:
    """A position in a list of tokens whose last one is of kind 'end'."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0
        self.found: list[tuple[int, str]] = []

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.tokens[self.i]
        if self.i < len(self.tokens) - 1:
            self.i += 1
        return t

    def is_op(self, *texts: str) -> bool:
        t = self.tokens[self.i]
        return t.kind == "op" and t.text in texts

    def is_word(self, *texts: str) -> bool:
        t = self.tokens[self.i]
        return t.kind == "name" and t.text in texts

    def skip_op(self, *texts: str) -> bool:
        if self.is_op(*texts):
            self.i += 1
            return True
        return False

    def skip_word(self, *texts: str) -> bool:
        if self.is_word(*texts):
            self.i += 1
            return True
        return False

    def need_op(self, text: str) -> Token:
        if not self.is_op(text):
            self.fail(f"expected '{text}'")
        return self.take()

    def need_word(self, text: str) -> Token:
        if not self.is_word(text):
            self.fail(f"expected '{text}'")
        return self.take()

    def fail(self, message: str) -> None:
        t = self.now
        raise Fault(t.line, f"{message}, found {t.text!r}" if t.text.strip() else message)

    def note(self, fault: Fault) -> None:
        self.found.append((fault.line, fault.message))
