"""Reading a specification: YAML files to an :class:`Ontology`, all problems at once.

Every kind of mapping has a row in ``SHAPES``: its required and optional keys with a
check for each. One walk applies a row; builders then see only well-formed mappings.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

import yaml

from .errors import Report, hint
from .functions.expr import ExprError, Node, parse
from .model import About, Action, Kind, Link, Ontology, Param, Place, Prop, Rule, Side
from .types import KINDS, PropType
from .validate import validate

CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
STATUSES = ("active", "deprecated", "experimental")
OPERATIONS = {"create": "createObject", "modify": "modifyObject", "delete": "deleteObject"}
SKIPPED = ("strataview.yaml", "strataview.yml")


def _is(kind: type, what: str) -> Callable[[Any], str | None]:
    return lambda v: None if isinstance(v, kind) and not (kind is int and isinstance(v, bool)) else f"must be {what}"


def _among(names: tuple[str, ...]) -> Callable[[Any], str | None]:
    return lambda v: None if v in names else f"must be one of {', '.join(names)}{hint(v, names)}"


TEXT, FLAG, MAP, LIST, WHOLE = _is(str, "a string"), _is(bool, "true or false"), _is(dict, "a mapping"), _is(list, "a list"), _is(int, "an integer")
NAMED = lambda v: None if isinstance(v, str) and v else "must be a name"
ANY = lambda v: None
COMMON = {"displayName": TEXT, "description": TEXT, "status": _among(STATUSES)}
TYPED = {"values": LIST, "precision": WHOLE, "scale": WHOLE, "description": TEXT}
SHAPES: dict[str, tuple[dict[str, Callable], dict[str, Callable]]] = {
    "objectType": ({"apiName": NAMED, "primaryKey": NAMED, "title": NAMED, "backing": MAP, "properties": LIST}, COMMON | {"searchable": LIST}),
    "backing": ({"catalog": NAMED, "table": NAMED}, {}),
    "property": ({"name": NAMED, "type": _among(KINDS), "column": NAMED}, TYPED | {"nullable": FLAG, "unique": FLAG, "renamedFrom": NAMED}),
    "linkType": ({"apiName": NAMED, "cardinality": _among(CARDINALITIES), "from": MAP, "to": MAP}, COMMON | {"reverseName": NAMED, "through": MAP}),
    "end": ({"objectType": NAMED, "property": NAMED}, {}),
    "through": ({"catalog": NAMED, "table": NAMED, "fromColumn": NAMED, "toColumn": NAMED}, {"renamedFrom": MAP}),
    "renamedFrom": ({}, {"fromColumn": NAMED, "toColumn": NAMED}),
    "action": ({"apiName": NAMED, "targetObjectType": NAMED, "operation": _among(tuple(OPERATIONS)), "effects": LIST}, COMMON | {"parameters": LIST, "validation": LIST}),
    "parameter": ({"name": NAMED, "type": _among(KINDS)}, TYPED | {"objectType": NAMED, "required": FLAG, "default": ANY}),
    "rule": ({"rule": TEXT, "message": TEXT}, {}),
    "createObject": ({"set": MAP}, {}),
    "modifyObject": ({"key": TEXT, "set": MAP}, {}),
    "deleteObject": ({"key": TEXT}, {}),
}


class _Reader:
    def __init__(self, report: Report, where: str):
        self.report, self.where = report, where

    def at(self, part: object) -> _Reader:
        return _Reader(self.report, f"{self.where}: {part}")

    def error(self, text: str) -> None:
        self.report.error(self.where, text)

    def shape(self, kind: str, raw: Any) -> bool:
        """Whether ``raw`` is a well-formed mapping of this kind; problems are reported."""
        if not isinstance(raw, dict):
            self.error("must be a mapping")
            return False
        need, may = SHAPES[kind]
        before = len(self.report.errors)
        for k in raw:
            if k not in need and k not in may:
                self.error(f"unknown key '{k}'{hint(k, [*need, *may])}")
        for k in need:
            if k not in raw:
                self.error(f"'{k}' is missing")
        for k, check in (need | may).items():
            if k in raw and (k in need or raw[k] is not None) and (bad := check(raw[k])):
                self.error(f"'{k}' {bad}")
        return len(self.report.errors) == before

    def expr(self, text: Any) -> Node | None:
        if not isinstance(text, str):
            self.error("must be an expression, written as a string")
            return None
        try:
            return parse(text)
        except ExprError as e:
            self.error(str(e))
            return None

    def type(self, raw: dict) -> PropType | None:
        kind = raw["type"]
        if kind == "enum":
            values = [str(v) for v in raw.get("values") or []]
            if not values or len(set(values)) < len(values):
                self.error("an enum needs 'values', each once")
                return None
            return PropType(kind, tuple(values))
        if kind == "decimal":
            p, s = raw.get("precision"), raw.get("scale")
            if not isinstance(p, int) or not isinstance(s, int) or not 1 <= p <= 38 or not 0 <= s <= p:
                self.error("a decimal needs a precision of 1 to 38 and a scale of 0 to the precision")
                return None
            return PropType(kind, precision=p, scale=s)
        if kind == "objectRef":
            if not raw.get("objectType"):
                self.error("an objectRef needs 'objectType'")
                return None
            return PropType(kind, object_type=raw["objectType"])
        return PropType(kind)

    def object_type(self, raw: dict) -> Kind | None:
        props: dict[str, Prop] = {}
        for i, p in enumerate(raw["properties"]):
            r = self.at(p.get("name", f"property {i + 1}") if isinstance(p, dict) else f"property {i + 1}")
            if r.shape("property", p) and (t := r.type(p)):
                if p.get("renamedFrom") == p["column"]:
                    r.error("'renamedFrom' is the column's present name")
                if p["name"] in props:
                    r.error("a property of this name is declared twice")
                flags = frozenset(k for k in ("nullable", "unique") if p.get(k))
                props[p["name"]] = Prop(p["column"], p["name"], t, flags, p.get("renamedFrom"), p.get("description") or "")
        if not self.at("backing").shape("backing", raw["backing"]):
            return None
        b = raw["backing"]
        return Kind(raw["apiName"], Place(b["catalog"], b["table"]), props, raw["primaryKey"], raw["title"], tuple(map(str, raw.get("searchable") or [])), _about(raw))

    def link(self, raw: dict) -> Link | None:
        if not all([self.at(k).shape("end", raw[k]) for k in ("from", "to")]):
            return None
        via, t = None, raw.get("through") or {}
        if t:
            if not self.at("through").shape("through", t) or (t.get("renamedFrom") and not self.at("through").shape("renamedFrom", t["renamedFrom"])):
                return None
            via = Place(t["catalog"], t["table"])
        was = t.get("renamedFrom") or {}
        sides = [Side(raw[k]["objectType"], raw[k]["property"], t.get(f"{k}Column"), was.get(f"{k}Column")) for k in ("from", "to")]
        return Link(raw["apiName"], raw["cardinality"], (sides[0], sides[1]), raw.get("reverseName"), via, _about(raw))

    def action(self, raw: dict) -> Action | None:
        params, rules, effects = {}, [], []
        for p in raw.get("parameters") or []:
            r = self.at(p.get("name", "parameter") if isinstance(p, dict) else "parameter")
            if r.shape("parameter", p) and (t := r.type(p)):
                if p["name"] in params:
                    r.error("a parameter of this name is declared twice")
                params[p["name"]] = Param(t, p.get("required", True), p.get("default"), p.get("description") or "")
        for v in raw.get("validation") or []:
            r = self.at("validation")
            if r.shape("rule", v) and (e := r.expr(v["rule"])):
                rules.append(Rule(e, v["rule"], v["message"]))
        for e in raw["effects"]:
            r = self.at("effects")
            if not isinstance(e, dict) or len(e) != 1 or next(iter(e)) not in OPERATIONS.values():
                r.error(f"an effect is one of {', '.join(OPERATIONS.values())}")
                continue
            (op, body), r = next(iter(e.items())), self.at(next(iter(e)))
            if r.shape(op, body):
                key = r.at("key").expr(body["key"]) if "key" in body else None
                effects.append((op, key, {k: n for k, v in (body.get("set") or {}).items() if (n := r.at(k).expr(v))}))
        if len(effects) != 1 or effects[0][0] != OPERATIONS[raw["operation"]]:
            self.error(f"a {raw['operation']} action needs exactly one {OPERATIONS[raw['operation']]} effect")
            return None
        _, key, sets = effects[0]
        return Action(raw["apiName"], raw["operation"], raw["targetObjectType"], params, sets, key, tuple(rules), _about(raw))


def _about(raw: dict) -> About:
    return About(raw.get("displayName") or "", raw.get("description") or "", raw.get("status") or "active")


def read_dir(root: str | Path, report: Report) -> Ontology:
    """All spec files below ``root``, one declaration each; deployment files are passed over."""
    out = Ontology()
    root = Path(root)
    for f in [*sorted(root.rglob("*.yaml")), *sorted(root.rglob("*.yml"))]:
        if f.name not in SKIPPED:
            try:
                doc = yaml.safe_load(f.read_text())
            except yaml.YAMLError as e:
                report.error(str(f), f"not YAML: {e}")
                continue
            if doc is not None:
                read_document(doc, str(f), out, report)
    return out


def read_document(doc: Any, where: str, out: Ontology, report: Report) -> None:
    kinds = {"objectType": ("object_type", out.objects), "linkType": ("link", out.links), "action": ("action", out.actions)}
    r = _Reader(report, where)
    found = [k for k in doc if k in kinds] if isinstance(doc, dict) else []
    if len(found) != 1:
        r.error(f"a file declares exactly one of {', '.join(kinds)}")
        return
    for k in doc:
        if k not in kinds:
            r.error(f"unknown key '{k}'{hint(k, kinds)}")
    kind = found[0]
    build, into = kinds[kind]
    if not r.shape(kind, doc[kind]):
        return
    made = getattr(r.at(doc[kind]["apiName"]), build)(doc[kind])
    if made and made.name in into:
        r.error(f"{kind} '{made.name}' is declared twice")
    elif made:
        into[made.name] = made


def build(root: str | Path) -> tuple[Ontology, Report]:
    """The validated specification below ``root``, with its warnings; SpecErrors where it has errors."""
    report = Report()
    ontology = read_dir(root, report)
    if not report.errors:
        validate(ontology, report)
    report.check()
    return ontology, report


def from_documents(docs: list[dict]) -> Ontology:
    """The same from documents already in memory."""
    report, out = Report(), Ontology()
    for i, d in enumerate(docs):
        read_document(d, f"document {i + 1}", out, report)
    if not report.errors:
        validate(out, report)
    report.check()
    return out
