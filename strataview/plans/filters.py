"""A caller's filters: what each property admits, and their conditions.

A filter maps a property to a bare value or to operators with operands. A bare value
means ``contains`` for a searchable string and ``eq`` for all else.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError, hint
from ..functions.columns import quoted
from ..model import Kind, Prop
from ..types import ORDERED, coerce

#: In the order in which conditions are made.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(v),
    "ne": lambda c, v: ~c.eqNullSafe(v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: F.lower(c).contains(F.lower(v)),
}


def operators(x: Kind, p: Prop) -> tuple[str, ...]:
    """The operators that a property admits."""
    out = ["eq", "ne"]
    if p.type.kind in ORDERED:
        out += ["gt", "gte", "lt", "lte"]
    if p.type.kind == "string" and p.name in x.search:
        out.append("contains")
    return tuple(out)


def conditions(x: Kind, filters: Mapping[str, Any], masked: frozenset[str] = frozenset()) -> list[Column]:
    """One condition for every operator; QueryError for whatever can't be asked."""
    out = []
    names = [n for n in x.props if n not in masked]
    for name, asked in filters.items():
        p = x.props.get(name)
        if p is None:
            raise QueryError(f"{x.name} has no property '{name}'{hint(name, names)}; it has {', '.join(names)}")
        if name in masked:
            raise QueryError(f"'{name}' is withheld here and can't be filtered on")
        admitted = operators(x, p)
        if asked is None:
            raise QueryError(f"'{name}': write {{eq: null}} to ask for nulls")
        if not isinstance(asked, Mapping):
            asked = {"contains" if "contains" in admitted else "eq": asked}
        if not asked:
            raise QueryError(f"'{name}': no operator is given")
        for op in asked:
            if op not in OPERATORS:
                raise QueryError(f"'{name}': no operator '{op}'{hint(op, OPERATORS)}")
            if op not in admitted:
                why = "only searchable strings admit it" if op == "contains" else f"{p.type} has no order"
                raise QueryError(f"'{name}': '{op}' doesn't apply; {why}")
        for op, make in OPERATORS.items():
            if op in asked:
                out.append(_condition(p, op, asked[op], make))
    return out


def _condition(p: Prop, op: str, value: Any, make: Callable[[Column, Column], Column]) -> Column:
    c = quoted(p.column)
    if value is None:
        if op not in ("eq", "ne"):
            raise QueryError(f"'{p.name}': '{op}' needs a value")
        return c.isNull() if op == "eq" else c.isNotNull()
    if op == "contains":
        if not isinstance(value, str):
            raise QueryError(f"'{p.name}': contains needs a string")
        return make(c, F.lit(value))
    try:
        v = coerce(p.type, value, what=f"'{p.name}'")
    except ValueError as e:
        raise QueryError(str(e)) from None
    return make(c, F.lit(v).cast(p.type.spark()))


def json_schema(x: Kind, masked: frozenset[str] = frozenset()) -> dict[str, Any]:
    """The schema of a search's filters: for each property its bare value or its operators."""
    out = {}
    for p in x.props.values():
        if p.name in masked:
            continue
        one = p.type.json_schema()
        maybe = {**one, "type": [one["type"], "null"], **({"enum": [*one["enum"], None]} if "enum" in one else {})}
        ops = {op: {"type": "string"} if op == "contains" else maybe if op in ("eq", "ne") else one for op in operators(x, p)}
        out[p.name] = {"anyOf": [one, {"type": "object", "properties": ops, "additionalProperties": False, "minProperties": 1}]}
    return {"type": "object", "properties": out, "additionalProperties": False}
