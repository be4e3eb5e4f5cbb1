"""The full-text query language.

    or    := and ("OR" and)*            and := not ("AND" not)*
    not   := group ("NOT" group)*       group := item+ (side by side: all must match)
    item  := [columns ":"] ( "(" or ")" | near | ["^"] phrase )
    near  := NEAR "(" phrase+ ["," n] ")"
    phrase := string ("+" string)* ["*"]

Operators are upper-case words. Anything that doesn't parse raises ``QueryError``; ``sanitised``
then makes a query of quoted words from it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .terms import COLUMNS, terms


class QueryError(ValueError):
    """A query that can't be understood."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    kind: str  # AND, OR, NOT
    left: object
    right: object


LEXEME = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[(){}:+*^,\-])|(?P<word>[\w\x80-\U0010ffff]+))')


def lexemes(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXEME.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r}")
        kind = m.lastgroup or ""
        out.append((kind, m[kind]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str) -> None:
        self.left = lexemes(text)

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.left[n] if n < len(self.left) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or value is not None and got[1] != value:
            raise QueryError(f"expected {value or 'more'}, found {got[1] or 'the end'!r}")
        del self.left[0]
        return got

    def chain(self, kind: str, below) -> object:
        out = below()
        while self.peek() == ("word", kind):
            self.take()
            out = Both(kind, out, below())
        return out

    def any_of(self) -> object:
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.group)))

    def group(self) -> object:
        out = self.item(COLUMNS)
        while self.peek()[0] != "end" and self.peek()[1] not in (")", "AND", "OR", "NOT"):
            out = Both("AND", out, self.item(COLUMNS))
        return out

    def columns(self) -> tuple[str, ...] | None:
        minus = self.peek() == ("mark", "-")
        at = int(minus)
        if self.peek(at)[1] == "{" and self.peek(at)[0] == "mark":
            names, at = [], at + 1
            while self.peek(at)[1] != "}":
                if self.peek(at)[0] == "end":
                    raise QueryError("unclosed column list")
                names.append(self.peek(at)[1])
                at += 1
            at += 1
        elif self.peek(at)[0] in ("word", "quoted") and self.peek(at + 1) == ("mark", ":"):
            names, at = [self.peek(at)[1]], at + 1
        else:
            if minus:
                raise QueryError("unexpected '-'")
            return None
        if self.peek(at) != ("mark", ":"):
            raise QueryError("expected ':'")
        del self.left[: at + 1]
        names = [n.strip('"').lower() for n in names]
        for n in names:
            if n not in (*COLUMNS, "id"):
                raise QueryError(f"no such column: {n}")
        return tuple(c for c in COLUMNS if (c in names) != minus)

    def item(self, held: tuple[str, ...]) -> object:
        names = self.columns()
        held = tuple(c for c in held if c in names) if names is not None else held
        if self.peek() == ("mark", "("):
            self.take()
            out = narrowed(self.any_of(), held)
            self.take(")")
            return out
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.take(), self.take()
            found, distance = [], 10
            while self.peek()[1] not in (")", ","):
                found.append(self.phrase(held))
            if self.peek()[1] == ",":
                self.take()
                n = self.take()[1]
                if not n.isdigit():
                    raise QueryError("expected a number")
                distance = int(n)
            self.take(")")
            return Near(tuple(found), distance)
        return self.phrase(held)

    def phrase(self, held: tuple[str, ...]) -> Phrase:
        first = self.peek() == ("mark", "^")
        if first:
            self.take()
        found: list[str] = []
        while True:
            kind, value = self.take()
            if kind == "mark" or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryError(f"unexpected {value!r}")
            found += terms(value[1:-1].replace('""', '"') if kind == "quoted" else value)
            if self.peek() != ("mark", "+"):
                break
            self.take()
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(tuple(found), prefix, first, held)


def narrowed(node: object, held: tuple[str, ...]) -> object:
    if isinstance(node, Phrase):
        return replace(node, columns=tuple(c for c in node.columns if c in held))
    if isinstance(node, Near):
        return replace(node, phrases=tuple(narrowed(p, held) for p in node.phrases))
    return Both(node.kind, narrowed(node.left, held), narrowed(node.right, held))


def parse(text: str) -> object:
    parser = Parser(text)
    out = parser.any_of()
    if parser.peek()[0] != "end":
        raise QueryError(f"unexpected {parser.peek()[1]!r}")
    return out


def sanitised(text: str) -> str:
    return " ".join(w.upper() if w.upper() in ("AND", "OR", "NOT") else '"' + w.replace('"', '""') + '"' for w in text.split())


def understood(text: str) -> object:
    """The query as written, or else with its words quoted."""
    try:
        return parse(text)
    except QueryError:
        return parse(sanitised(text))
