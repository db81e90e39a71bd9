"""Expression trees as Spark columns, in two modes that are never mixed.

``predicate`` compiles row policies: ``==`` and ``!=`` are null-safe, orderings and the
connectives are three-valued, and ``where`` then admits on true alone. ``strict`` compiles
rules and effects for whole tables: where a row's evaluation would fail (a null operand
of an ordering, a division by zero) the value is null, and ``&&`` and ``||`` decide from
left to right without looking further than they must.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Mapping
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PolicyError
from .expr import Binary, Call, Literal, Node, Ref, Unary

ORDERINGS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}

def undecided() -> Column:
    """A condition that is neither true nor false for any row."""
    return F.lit(None).cast("boolean")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def compare(op: str, a: Column, b: Column) -> Column:
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    return ORDERINGS[op](a, b)


MISSING = object()


def predicate(node: Node, column: Callable[[str], Column], claims: Mapping[str, Any] | None = None) -> Column:
    """A row policy as a condition; ``column`` gives the column of a property.

    The caller's claims are folded to literals. A claim that is absent leaves its
    comparison undecided, which is not the same as comparing with null.
    """

    def operand(n: Node) -> Column | object:
        if isinstance(n, Literal):
            return F.lit(n.value)
        if isinstance(n, Unary) and n.op == "-" and isinstance(n.arg, Literal):
            return F.lit(-n.arg.value)
        if isinstance(n, Ref) and n.path[0] == "object" and len(n.path) == 2:
            return column(n.path[1])
        if isinstance(n, Ref) and n.path[0] == "principal" and len(n.path) == 2:
            v = (claims or {}).get(n.path[1], MISSING)
            return MISSING if v is MISSING else F.lit(v)
        raise PolicyError(f"a row policy can't compare {n}")

    if isinstance(node, Unary) and node.op == "!":
        return ~predicate(node.arg, column, claims)
    if isinstance(node, Binary) and node.op in ("&&", "||"):
        a, b = predicate(node.left, column, claims), predicate(node.right, column, claims)
        return a & b if node.op == "&&" else a | b
    if isinstance(node, Binary):
        a, b = operand(node.left), operand(node.right)
        return undecided() if a is MISSING or b is MISSING else compare(node.op, a, b)
    if isinstance(node, Literal) and isinstance(node.value, bool):
        return F.lit(node.value)
    raise PolicyError("a row policy must be a condition")


def strict(
    node: Node, column: Callable[[str], Column], params: Mapping[str, Any] | None = None, now: datetime | None = None, texts: Container[str] = ()
) -> Column:
    """A rule or effect over a whole table; null where a row's evaluation fails. ``texts`` names the properties that hold text."""
    go = lambda n: strict(n, column, params, now, texts)
    is_text = lambda n: _is_text(n, params or {}, texts)
    match node:
        case Literal(value=v):
            return F.lit(v)
        case Ref(path=("object", name)):
            return column(name)
        case Ref(path=(name,)):
            v = (params or {})[name]
            return F.lit(v).cast("timestamp") if isinstance(v, datetime) else F.lit(v).cast("date") if isinstance(v, date) else F.lit(v)
        case Unary(op="!", arg=a):
            return ~go(a)
        case Unary(op="-", arg=a):
            return -go(a)
        case Binary(op="&&", left=a, right=b):
            x = go(a)
            return F.when(x.isNull(), undecided()).when(~x, F.lit(False)).otherwise(go(b))
        case Binary(op="||", left=a, right=b):
            x = go(a)
            return F.when(x.isNull(), undecided()).when(x, F.lit(True)).otherwise(go(b))
        case Binary(op="/", left=a, right=b):
            return F.try_divide(go(a), go(b))
        case Binary(op="+", left=a, right=b) if is_text(a) or is_text(b):
            return F.concat(go(a), go(b))
        case Binary(op=("+" | "-" | "*") as op, left=a, right=b):
            return {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op](go(a), go(b))
        case Binary(op=op, left=a, right=b):
            return compare(op, go(a), go(b))
        case Call(name="lower", args=(a,)):
            return F.lower(go(a))
        case Call(name="upper", args=(a,)):
            return F.upper(go(a))
        case Call(name="len", args=(a,)):
            return F.length(go(a))
        case Call(name="coalesce", args=args):
            return F.coalesce(*map(go, args))
        case Call(name="now"):
            return F.lit(now).cast("timestamp")
    raise PolicyError(f"can't compile {node}")


def _is_text(n: Node, params: Mapping[str, Any], texts: Container[str]) -> bool:
    """Whether a ``+`` operand is text: by its form, its property's declared type, or its parameter's value."""
    match n:
        case Literal(value=str()) | Call(name="lower" | "upper"):
            return True
        case Ref(path=("object", name)):
            return name in texts
        case Ref(path=(name,)):
            return isinstance(params.get(name), str)
        case Call(name="coalesce", args=args):
            return any(_is_text(a, params, texts) for a in args)
        case Binary(op="+", left=a, right=b):
            return _is_text(a, params, texts) or _is_text(b, params, texts)
    return False


def conjunction(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None
