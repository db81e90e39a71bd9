"""What the declared tables ask of the live ones, and how grave each change is."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql.types import DataType, StructField, StructType

from ..errors import Report
from ..model import Kind, Ontology
from ..sources.catalog import Catalog
from ..types import physical, promotable

SAFE, PHYSICAL, BREAKING = "safe", "physical-safe", "breaking"


@dataclass
class Want:
    """A declared column: its type, whether it may be null, its former names."""

    name: str
    kind: DataType
    nullable: bool
    former: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class Change:
    op: str  # create, add, rename, promote, retype, loosen, tighten
    catalog: str
    table: str
    column: str | None
    severity: str
    text: str
    old: str | None = None


@dataclass
class Plan:
    changes: list[Change] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    unmanaged: dict[str, list[str]] = field(default_factory=dict)

    @property
    def breaking(self) -> list[Change]:
        return [c for c in self.changes if c.severity == BREAKING]

    def tables(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys((c.catalog, c.table) for c in self.changes))

    def render(self) -> str:
        if not self.changes and not self.warnings:
            return "Nothing to change."
        out = []
        for t in self.tables():
            out.append(f"{t[0]}: {t[1]}")
            out += [f"  [{c.severity}] {c.text}" for c in self.changes if (c.catalog, c.table) == t]
        out += [f"warning: {w}" for w in self.warnings]
        out += [f"{t}: not declared, left alone: {', '.join(c)}" for t, c in self.unmanaged.items() if c]
        return "\n".join(out)


def desired(o: Ontology, report: Report | None = None) -> dict[tuple[str, str], dict[str, Want]]:
    """Columns of every declared table. Where declarations share one, the laxer nullability holds."""
    report = report or Report()
    out: dict[tuple[str, str], dict[str, Want]] = {}

    def want(where: str, catalog: str, table: str, name: str, kind: DataType, nullable: bool, former: str | None) -> None:
        columns = out.setdefault((catalog, table), {})
        w = columns.setdefault(name, Want(name, kind, nullable))
        if w.kind != kind:
            report.error(where, f"column '{table}.{name}' is declared both {physical(w.kind)} and {physical(kind)}")
        w.nullable |= nullable
        if former:
            w.former.add(former)

    for x in o.objects.values():
        for p in x.props.values():
            want(x.name, *x.place, p.column, p.type.spark(o.objects), p.nullable, p.was)
    for link in o.links.values():
        for s in link.sides if link.via else ():
            want(link.name, *link.via, s.column, o.objects[s.kind].props[s.prop].type.spark(o.objects), False, s.was)
    for (_, table), columns in out.items():
        used: dict[str, str] = {}
        for w in columns.values():
            for f in w.former:
                if len(w.former) > 1:
                    report.error(table, f"'{w.name}' has two former names")
                if f in columns:
                    report.error(table, f"'{f}' is both a present column and a former name")
                if used.setdefault(f, w.name) != w.name:
                    report.error(table, f"'{f}' is renamed twice")
    report.check()
    return out


def plan(o: Ontology, catalogs: Mapping[str, Catalog]) -> Plan:
    out = Plan()
    for (catalog, table), columns in desired(o).items():
        c = catalogs[catalog]
        if not c.exists(table):
            out.changes.append(Change("create", catalog, table, None, SAFE, f"create table with {', '.join(columns)}"))
            continue
        live = {f.name: f for f in c.schema(table)}
        claimed = set()
        for w in columns.values():
            claimed |= {w.name, *w.former}
            out.changes += _column(w, live, catalog, table, out)
        out.unmanaged[table] = [n for n in live if n not in claimed]
    return out


def _column(w: Want, live: Mapping[str, StructField], catalog: str, table: str, out: Plan) -> list[Change]:
    change = lambda op, severity, text, old=None: Change(op, catalog, table, w.name, severity, text, old)
    former = next(iter(w.former), None)
    found, done = live.get(w.name), []
    if former and former in live:
        if found is not None:
            return [change("rename", BREAKING, f"both '{former}' and '{w.name}' exist; they can't be merged", former)]
        found = live[former]
        done.append(change("rename", PHYSICAL, f"rename '{former}' to '{w.name}'", former))
    if found is None:
        if former:
            out.warnings.append(f"{table}: neither '{former}' nor '{w.name}' exists; '{w.name}' is added anew")
        kind = physical(w.kind)
        return [change("add", SAFE if w.nullable else BREAKING, f"add '{w.name}' {kind}" + ("" if w.nullable else ", which can't be null in rows that exist"))]
    have, need = physical(found.dataType), physical(w.kind)
    if have != need:
        ok = promotable(have, need)
        done.append(change("promote" if ok else "retype", PHYSICAL if ok else BREAKING, f"'{w.name}' from {have} to {need}"))
    if not found.nullable and w.nullable:
        done.append(change("loosen", PHYSICAL, f"'{w.name}' may be null"))
    if found.nullable and not w.nullable:
        done.append(change("tighten", BREAKING, f"'{w.name}' may hold nulls now, and is declared without"))
    return done


def struct(columns: Mapping[str, Want]) -> StructType:
    return StructType([StructField(w.name, w.kind, w.nullable) for w in columns.values()])


def declared(x: Kind, o: Ontology) -> StructType:
    """One object type's own columns, in declared order."""
    return StructType([StructField(p.column, p.type.spark(o.objects), p.nullable) for p in x.props.values()])
