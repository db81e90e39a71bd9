"""Governance: masks, row policies and guards, bound once and decided for each caller.

A :class:`Program` holds what a deployment declares, checked against the specification.
``select(caller)`` evaluates the guards and gives a :class:`PolicySet`, which alone may
read or write. A guard that can't be evaluated counts as true: the policy then applies.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PolicyError, hint
from ..functions.columns import conjunction, predicate, quoted
from ..functions.evaluate import EvalError, Scope, evaluate
from ..functions.expr import LEVELS, Binary, Literal, Node, Ref, Unary, parse, walk
from ..model import Kind, Ontology
from ..types import PropType, comparable

CLAIM_KINDS = {"string": str, "boolean": bool, "int": int, "long": int, "double": float}
BUILT_IN = {"sub": "string", "iss": "string"}


@dataclass(frozen=True)
class Policy:
    name: str
    object_type: str
    mask: tuple[str, ...] = ()
    rows: Node | None = None
    when: Node | None = None


@dataclass(frozen=True)
class Principal:
    """A verified caller: the claims that are readable, of their declared kinds."""

    claims: Mapping[str, Any]

    @classmethod
    def of(cls, raw: Mapping[str, Any], declared: Mapping[str, str] | None = None) -> Principal:
        kinds = {**(declared or {}), **BUILT_IN}
        return cls({k: v for k, v in raw.items() if k in kinds and _fits(v, kinds[k])})


def _fits(v: Any, kind: str) -> bool:
    if kind.endswith("[]"):
        return isinstance(v, list) and all(_fits(x, kind[:-2]) for x in v)
    if kind == "double":
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    return isinstance(v, CLAIM_KINDS[kind]) and (kind == "boolean" or not isinstance(v, bool))


@dataclass(frozen=True)
class PolicySet:
    """Policies decided for one caller; only these may be applied."""

    policies: tuple[Policy, ...] = ()
    claims: Mapping[str, Any] = field(default_factory=dict)
    decided: bool = True

    def _own(self, object_type: str) -> list[Policy]:
        if not self.decided:
            raise PolicyError("the policies aren't decided for a caller")
        return [p for p in self.policies if p.object_type == object_type]

    def masked(self, object_type: str) -> frozenset[str]:
        return frozenset(m for p in self._own(object_type) for m in p.mask)

    def rows(self, x: Kind) -> Column | None:
        """The condition on ``x``'s physical columns: all of its policies together."""
        find = lambda name: quoted(x.props[name].column)
        return conjunction([predicate(p.rows, find, self.claims) for p in self._own(x.name) if p.rows is not None])

    def admits(self, x: Kind) -> Column:
        """The same as a column that is true or false, never null."""
        rule = self.rows(x)
        return F.lit(True) if rule is None else F.coalesce(rule, F.lit(False))


OPEN = PolicySet()


@dataclass(frozen=True)
class Program:
    policies: tuple[Policy, ...] = ()
    claim_kinds: Mapping[str, str] = field(default_factory=dict)

    @property
    def conditional(self) -> bool:
        """Whether an answer depends on who asks."""
        return any(p.when is not None or (p.rows is not None and _reads_caller(p.rows)) for p in self.policies)

    def select(self, caller: Principal | None = None) -> PolicySet:
        if caller is None and self.conditional:
            raise PolicyError("these policies depend on the caller, and there is none")
        claims = caller.claims if caller else {}
        chosen = []
        for p in self.policies:
            if p.when is not None:
                try:
                    applies = evaluate(p.when, Scope(claims=claims)) is not False
                except EvalError:
                    applies = True
                if not applies:
                    continue
            chosen.append(p)
        return PolicySet(tuple(chosen), claims)


def _reads_caller(node: Node) -> bool:
    return any(isinstance(n, Ref) and n.path[0] == "principal" for n in walk(node))


def bind(raw: list[Mapping[str, Any]], o: Ontology, claim_kinds: Mapping[str, str] | None = None) -> Program:
    """Declared policies, checked against the specification; PolicyError names what can't be."""
    kinds = {**(claim_kinds or {}), **BUILT_IN}
    out: list[Policy] = []
    for r in raw:
        name = r.get("name")
        where = f"policy '{name}'"
        bad = lambda t, where=where: PolicyError(f"{where}: {t}")
        known = ("name", "objectType", "mask", "rows", "when", "description")
        for k in r:
            if k not in known:
                raise bad(f"unknown key '{k}'{hint(k, known)}")
        if not isinstance(name, str) or name in [p.name for p in out]:
            raise bad("a policy needs a name of its own")
        x = o.objects.get(r.get("objectType"))
        if x is None:
            raise bad(f"no object type '{r.get('objectType')}'{hint(r.get('objectType'), o.objects)}")
        mask = tuple(r.get("mask") or ())
        rows = parse(r["rows"]) if r.get("rows") is not None else None
        when = parse(r["when"]) if r.get("when") is not None else None
        if not mask and rows is None:
            raise bad("it withholds nothing")
        if when is not None and (rows is None or mask):
            raise bad("'when' goes with 'rows' alone")
        for m in mask:
            if why := _unmaskable(x, m, o):
                raise bad(f"'{m}' can't be masked: {why}")
        if rows is not None and (why := _unlowerable(rows, x, kinds)):
            raise bad(why)
        if rows is not None and not any(isinstance(n, Ref) and n.path[0] == "object" for n in walk(rows)):
            raise bad("the row policy reads no property")
        if when is not None and (why := _guard_problem(when, kinds)):
            raise bad(why)
        out.append(Policy(name, x.name, mask, rows, when))
    return Program(tuple(out), kinds)


def _unmaskable(x: Kind, name: str, o: Ontology) -> str | None:
    if name not in x.props:
        return f"{x.name} has no such property{hint(name, x.props)}"
    if name == x.key_name:
        return "it is the primary key"
    for link in o.links.values():
        if any((s.kind, s.prop) == (x.name, name) for s in link.sides):
            return f"link '{link.name}' joins on it"
    for a in o.actions.values():
        if a.target == x.name:
            reads = {n.path[1] for top in a.nodes() for n in walk(top) if isinstance(n, Ref) and n.path[0] == "object" and len(n.path) == 2}
            if name in reads | set(a.sets):
                return f"action '{a.name}' touches it"
    return None


def _operand(n: Node, x: Kind, kinds: Mapping[str, str]) -> PropType | str:
    """The type of a comparison's side, or why it can't be one."""
    if isinstance(n, Unary) and n.op == "-" and isinstance(n.arg, Literal):
        n = n.arg
    if isinstance(n, Literal):
        v = n.value
        return PropType("null") if v is None else PropType({bool: "boolean", int: "long", float: "double", str: "string"}[type(v)])
    if isinstance(n, Ref) and n.path[0] == "object" and len(n.path) == 2:
        p = x.props.get(n.path[1])
        return p.type if p else f"{x.name} has no property '{n.path[1]}'{hint(n.path[1], x.props)}"
    if isinstance(n, Ref) and n.path[0] == "principal" and len(n.path) == 2:
        kind = kinds.get(n.path[1])
        if kind is None:
            return f"no claim '{n.path[1]}' is declared{hint(n.path[1], kinds)}"
        return "a list can't be compared with a property" if kind.endswith("[]") else PropType(kind)
    if isinstance(n, Ref):
        return f"'{n}' is neither object.<property> nor principal.<claim>"
    return f"a row policy compares properties, literals and claims; it can't use {type(n).__name__.lower()} '{getattr(n, 'op', getattr(n, 'name', ''))}'"


def _unlowerable(n: Node, x: Kind, kinds: Mapping[str, str]) -> str | None:
    """Why a node is no row policy; None if it is one."""
    if isinstance(n, Unary) and n.op == "!":
        return _unlowerable(n.arg, x, kinds)
    if isinstance(n, Binary) and n.op in ("&&", "||"):
        return _unlowerable(n.left, x, kinds) or _unlowerable(n.right, x, kinds)
    if not isinstance(n, Binary) or n.op not in LEVELS[2] or n.op == "contains":
        return "a row policy is made of comparisons, '&&', '||' and '!'"
    a, b = _operand(n.left, x, kinds), _operand(n.right, x, kinds)
    if isinstance(a, str) or isinstance(b, str):
        return a if isinstance(a, str) else b
    if n.op in ("==", "!="):
        if "null" not in (a.kind, b.kind) and not comparable(a.kind, b.kind):
            return f"{a} and {b} can't be compared"
        for t, other in ((a, n.right), (b, n.left)):
            if t.kind == "enum" and isinstance(other, Literal) and other.value is not None and other.value not in t.values:
                return f"the enum has no value '{other.value}'{hint(other.value, t.values)}"
        return None
    if "null" in (a.kind, b.kind) or "boolean" in (a.kind, b.kind) or not comparable(a.kind, b.kind):
        return f"{a} and {b} have no order"
    return None


def _guard_problem(n: Node, kinds: Mapping[str, str]) -> str | None:
    for r in walk(n):
        if isinstance(r, Ref) and (r.path[0] != "principal" or len(r.path) != 2):
            return f"a guard reads the caller only, not '{r}'"
        if isinstance(r, Ref) and r.path[1] not in kinds:
            return f"no claim '{r.path[1]}' is declared{hint(r.path[1], kinds)}"
    return None
