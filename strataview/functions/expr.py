"""Expressions of rules, effects, row policies and guards: text to tree.

Operators by rising strength: ``||``, ``&&``, comparisons and ``contains``, ``+ -``,
``* /``, then ``! -`` before an operand. A whole expression may stand in ``{{ }}``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..errors import StrataError, hint

#: Functions with their least and greatest number of arguments.
FUNCTIONS = {"now": (0, 0), "lower": (1, 1), "upper": (1, 1), "len": (1, 1), "coalesce": (1, None)}
LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "contains"), ("+", "-"), ("*", "/"))
WORDS = {"true": True, "false": False, "null": None}


class ExprError(StrataError):
    """Text that is no expression."""


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Ref:
    path: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.path)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node


Node = Literal | Ref | Call | Unary | Binary

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'[^']*'|"[^"]*")|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|[=!<>]=|[-+*/<>!().,]))""")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExprError(f"can't read {text[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def next(self, *wanted: str) -> str | None:
        """Take the next token if it is one of the wanted operators or words."""
        kind, text = self.tokens[self.at]
        if kind in ("op", "name") and text in wanted:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.next(text):
            raise ExprError(f"expected {text!r}, found {self.tokens[self.at][1] or 'the end'!r}")

    def level(self, k: int = 0) -> Node:
        if k == len(LEVELS):
            return self.operand()
        left = self.level(k + 1)
        while op := self.next(*LEVELS[k]):
            left = Binary(op, left, self.level(k + 1))
        return left

    def operand(self) -> Node:
        if op := self.next("!", "-"):
            return Unary(op, self.operand())
        if self.next("("):
            inner = self.level()
            self.need(")")
            return inner
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Literal(float(text) if "." in text else int(text))
        if kind == "str":
            return Literal(text[1:-1])
        if kind != "name":
            raise ExprError(f"expected a value, found {text or 'the end'!r}")
        if text in WORDS:
            return Literal(WORDS[text])
        if self.next("("):
            return self.call(text)
        path = [text]
        while self.next("."):
            kind, part = self.tokens[self.at]
            if kind != "name":
                raise ExprError("a name must follow the dot")
            self.at += 1
            path.append(part)
        return Ref(tuple(path))

    def call(self, name: str) -> Node:
        if name not in FUNCTIONS:
            raise ExprError(f"no function {name!r}{hint(name, FUNCTIONS)}")
        args: list[Node] = []
        if not self.next(")"):
            args.append(self.level())
            while self.next(","):
                args.append(self.level())
            self.need(")")
        least, most = FUNCTIONS[name]
        if len(args) < least or (most is not None and len(args) > most):
            raise ExprError(f"{name}() doesn't take {len(args)} arguments")
        return Call(name, tuple(args))


def parse(text: str) -> Node:
    body = text.strip()
    if body.startswith("{{") and body.endswith("}}"):
        body = body[2:-2]
    if "{{" in body or "}}" in body:
        raise ExprError("braces may only enclose the whole expression")
    p = _Parser(body)
    out = p.level()
    if p.tokens[p.at][0] != "end":
        raise ExprError(f"unexpected {p.tokens[p.at][1]!r}")
    return out


def walk(node: Node) -> Iterator[Node]:
    yield node
    for child in {Call: lambda n: n.args, Unary: lambda n: (n.arg,), Binary: lambda n: (n.left, n.right)}.get(type(node), lambda n: ())(node):
        yield from walk(child)
