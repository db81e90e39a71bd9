"""Checks that need several declarations, or the live tables, at once."""

from __future__ import annotations

from typing import TYPE_CHECKING

from .errors import Report, hint
from .functions.expr import LEVELS, Binary, Call, Literal, Node, Ref, Unary
from .model import Action, Kind, Link, Ontology, Prop
from .types import NUMERIC, PropType, comparable, physical, promotable, stored_as

if TYPE_CHECKING:
    from .sources.catalog import Catalog

ORDERINGS = ("<", "<=", ">", ">=")
NULL = PropType("null")


class TypeProblem(Exception):
    pass


def _resolve(t: PropType, o: Ontology) -> PropType:
    return o.objects[t.object_type].key.type if t.kind == "objectRef" and t.object_type in o.objects else t


def same_family(a: PropType, b: PropType) -> bool:
    return "null" in (a.kind, b.kind) or comparable(a.kind, b.kind)


def infer(node: Node, o: Ontology, params: dict[str, PropType], target: Kind | None) -> PropType:
    """The type of a rule or effect expression; TypeProblem where it has none."""
    go = lambda n: infer(n, o, params, target)
    match node:
        case Literal(value=v):
            return NULL if v is None else PropType({bool: "boolean", int: "long", float: "double", str: "string"}[type(v)])
        case Ref(path=("object", name)) if target:
            if not (p := target.props.get(name)):
                raise TypeProblem(f"{target.name} has no property '{name}'{hint(name, target.props)}")
            return _resolve(p.type, o)
        case Ref(path=("object", _)):
            raise TypeProblem("there is no object to read here")
        case Ref(path=("principal", *_)):
            raise TypeProblem("the caller can't be read in a specification")
        case Ref(path=(name,)) if name in params:
            return _resolve(params[name], o)
        case Ref():
            raise TypeProblem(f"nothing is called '{node}'{hint(node, params)}")
        case Unary(op="!", arg=a):
            _want(go(a), ("boolean",), "!")
            return PropType("boolean")
        case Unary(arg=a):
            return _want(go(a), (*NUMERIC, "decimal"), "-")
        case Binary(op="contains"):
            raise TypeProblem("'contains' is for guards over the caller's claims only")
        case Binary(op=op, left=a, right=b) if op in ("&&", "||"):
            for side in (a, b):
                _want(go(side), ("boolean",), op)
            return PropType("boolean")
        case Binary(op=op, left=a, right=b) if op in LEVELS[2]:
            x, y = go(a), go(b)
            if not same_family(x, y):
                raise TypeProblem(f"{x} and {y} can't be compared")
            if op in ORDERINGS and ({"null", "boolean"} & {x.kind, y.kind}):
                raise TypeProblem(f"'{op}' needs two values with an order")
            return PropType("boolean")
        case Binary(op=op, left=a, right=b):
            x, y = go(a), go(b)
            if op == "+" and x.kind in ("string", "enum") and y.kind in ("string", "enum"):
                return PropType("string")
            for t in (x, y):
                _want(t, (*NUMERIC, "decimal"), op)
            if {x.kind, y.kind} >= {"decimal", "double"}:
                raise TypeProblem("decimals and doubles don't mix")
            if "decimal" in (x.kind, y.kind):
                return x if x.kind == "decimal" else y
            return PropType("double" if op == "/" or "double" in (x.kind, y.kind) else "long")
        case Call(name="now"):
            return PropType("timestamp")
        case Call(name="coalesce", args=args):
            types = [go(a) for a in args]
            known = [t for t in types if t.kind != "null"]
            if any(not same_family(known[0], t) for t in known):
                raise TypeProblem("coalesce() needs arguments of one kind")
            return known[0] if known else NULL
        case Call(name=name, args=(a,)):
            _want(go(a), ("string", "enum"), f"{name}()")
            return PropType("long" if name == "len" else "string")
    raise TypeProblem(f"can't type {node}")


def _want(t: PropType, kinds: tuple[str, ...], what: str) -> PropType:
    if t.kind not in kinds:
        raise TypeProblem(f"{what} doesn't take {t.kind}")
    return t


def validate(o: Ontology, report: Report) -> None:
    for x in o.objects.values():
        _object(x, report)
    if report.errors:
        return
    for link in o.links.values():
        _link(link, o, report)
    _names(o, report)
    for a in o.actions.values():
        _action(a, o, report)


def _object(x: Kind, report: Report) -> None:
    bad = lambda t: report.error(x.name, t)
    columns = [p.column for p in x.props.values()]
    for c in sorted({c for c in columns if columns.count(c) > 1}):
        bad(f"column '{c}' is declared twice")
    for what, name in [("primaryKey", x.key_name), ("title", x.title), *[("searchable", s) for s in x.search]]:
        if name not in x.props:
            bad(f"{what} names no property: '{name}'{hint(name, x.props)}")
    if key := x.props.get(x.key_name):
        if key.nullable:
            bad("the primary key can't be nullable")
        if not key.unique:
            bad("the primary key must be declared unique")
    for p in x.props.values():
        if p.type.kind == "objectRef":
            bad(f"property '{p.name}': objectRef is for parameters only")
    old = [p.was for p in x.props.values() if p.was]
    for r in sorted(set(old)):
        if old.count(r) > 1:
            bad(f"column '{r}' is renamed twice")
        if r in columns:
            bad(f"'{r}' is both a present column and a former name")


def _link(link: Link, o: Ontology, report: Report) -> None:
    bad = lambda t: report.error(link.name, t)
    found: list[Prop] = []
    for s in link.sides:
        if not (x := o.objects.get(s.kind)):
            bad(f"no object type '{s.kind}'{hint(s.kind, o.objects)}")
        elif not (p := x.props.get(s.prop)):
            bad(f"{s.kind} has no property '{s.prop}'{hint(s.prop, x.props)}")
        else:
            found.append(p)
    if (link.via is not None) != (link.cardinality == "many_to_many"):
        bad("'through' is for many_to_many links, and for these it is needed")
    if len(found) == 2 and not link.via:
        if not comparable(found[0].type.kind, found[1].type.kind):
            bad(f"{found[0].type} and {found[1].type} can't be joined")
        for p, many in zip(found, link.cardinality.split("_to_"), strict=True):
            if many == "one" and not p.unique:
                report.warn(link.name, f"'{p.name}' isn't declared unique; rows may repeat")


def _names(o: Ontology, report: Report) -> None:
    """The names by which links leave one object type are distinct."""
    taken: dict[tuple[str, str], str] = {}
    for link in o.links.values():
        for w in link.walks():
            if (other := taken.setdefault((w.near.kind, w.name), link.name)) != link.name:
                report.error(link.name, f"'{w.name}' already leads from {w.near.kind}, by '{other}'")


def _action(a: Action, o: Ontology, report: Report) -> None:
    bad = lambda t: report.error(a.name, t)
    target = o.objects.get(a.target)
    if not target:
        bad(f"no object type '{a.target}'{hint(a.target, o.objects)}")
        return
    for name, p in a.params.items():
        if p.type.kind == "objectRef" and p.type.object_type not in o.objects:
            bad(f"parameter '{name}' refers to no object type: '{p.type.object_type}'{hint(p.type.object_type, o.objects)}")
    params = {n: p.type for n, p in a.params.items()}
    readable = None if a.does == "create" else target

    def typed(node: Node, what: str, wanted: PropType, seen: Kind | None) -> None:
        try:
            t = infer(node, o, params, seen)
        except TypeProblem as e:
            bad(f"{what}: {e}")
            return
        if not same_family(t, _resolve(wanted, o)):
            bad(f"{what}: expected {wanted}, found {t}")

    for r in a.rules:
        typed(r.holds, f"rule '{r.text}'", PropType("boolean"), readable)
    if a.key is not None:
        typed(a.key, "key", target.key.type, None)
    for name, node in a.sets.items():
        if not (p := target.props.get(name)):
            bad(f"sets no property of {target.name}: '{name}'{hint(name, target.props)}")
        elif a.does == "modify" and name == target.key_name:
            bad("the primary key can't be modified")
        else:
            typed(node, f"set {name}", p.type, readable)
    if a.does == "create":
        for p in target.props.values():
            if not p.nullable and p.name not in a.sets:
                bad(f"doesn't set '{p.name}', which can't be null")


def validate_physical(o: Ontology, catalogs: dict[str, Catalog], report: Report) -> None:
    """The declared columns against the live tables."""
    for x in o.objects.values():
        where, table = x.place
        catalog = catalogs.get(where)
        if catalog is None:
            report.error(x.name, f"no catalog '{where}'{hint(where, catalogs)}")
            continue
        if not catalog.exists(table):
            report.error(x.name, f"table '{table}' doesn't exist")
            continue
        live = {f.name: f for f in catalog.schema(table)}
        for p in x.props.values():
            f = live.get(p.column) or live.get(p.was or "")
            if f is None:
                report.error(x.name, f"{table} has no column '{p.column}'{hint(p.column, live)}")
            elif not promotable(physical(f.dataType), stored_as(p.type)):
                report.error(x.name, f"column '{p.column}' is {physical(f.dataType)}, declared {stored_as(p.type)}")
            elif f.nullable and not p.nullable:
                say = report.error if p is x.key else report.warn
                say(x.name, f"column '{p.column}' may hold nulls, property '{p.name}' may not")
    for link in o.links.values():
        if link.via:
            catalog = catalogs.get(link.via.catalog)
            if catalog is None or not catalog.exists(link.via.table):
                report.error(link.name, f"mapping table '{link.via.table}' doesn't exist")
                continue
            names = [f.name for f in catalog.schema(link.via.table)]
            for s in link.sides:
                if s.column not in names:
                    report.error(link.name, f"{link.via.table} has no column '{s.column}'{hint(s.column, names)}")
