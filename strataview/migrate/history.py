"""Applying plans, one commit a table, with a history that can be rolled back to."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..errors import QueryError, StrataError
from ..model import Ontology
from ..sources.store import TableStore
from ..spec import SKIPPED, from_documents
from .plan import Plan, desired, plan, struct

TABLE = "strataview_meta.applied"
SCHEMA = StructType(
    [
        StructField("version", LongType(), False),
        StructField("applied_at", TimestampType(), False),
        *[StructField(c, StringType()) for c in ("content_hash", "spec", "summary", "status", "library", "actor")],
    ]
)


def read_spec(root: str | Path) -> dict[str, str]:
    """The spec files below a folder, by relative path."""
    root = Path(root)
    return {str(f.relative_to(root)): f.read_text() for f in sorted([*root.rglob("*.yaml"), *root.rglob("*.yml")]) if f.name not in SKIPPED}


def canonical(files: Mapping[str, str]) -> str:
    return json.dumps({k: yaml.safe_load(v) for k, v in files.items()}, sort_keys=True, default=str)


def content_hash(files: Mapping[str, str]) -> str:
    return hashlib.sha256(canonical(files).encode()).hexdigest()


def ontology_of(files: Mapping[str, str]) -> Ontology:
    return from_documents([d for v in files.values() if (d := yaml.safe_load(v)) is not None])


@dataclass
class Applied:
    status: str  # applied, up-to-date, refused or partial
    version: int | None
    plan: Plan
    done: list[str]
    error: str | None = None


class History:
    """Versions are numbered through all catalogs' histories."""

    def __init__(self, stores: Mapping[str, TableStore]):
        self.stores = stores

    def rows(self) -> list[dict[str, Any]]:
        out = [r.asDict() for s in self.stores.values() if s.exists(TABLE) for r in s.table(TABLE).collect()]
        return sorted(out, key=lambda r: r["version"])

    def last(self) -> int:
        """The greatest version in use, 0 without any."""
        tops = [s.table(TABLE).agg(F.max("version")).first()[0] for s in self.stores.values() if s.exists(TABLE)]
        return max((t for t in tops if t is not None), default=0)

    def at(self, version: int) -> dict[str, Any]:
        for r in self.rows():
            if r["version"] == version:
                return r
        raise QueryError(f"version {version} was never applied")

    def record(self, catalog: str, **row: Any) -> None:
        s = self.stores[catalog]
        if not s.exists(TABLE):
            s.create(TABLE, SCHEMA)
        s.append_rows(TABLE, [row])


def apply(files: Mapping[str, str], stores: Mapping[str, TableStore], actor: str | None = None, now: datetime | None = None, note: str = "", plan_: Plan | None = None) -> Applied:
    """Bring the tables to the spec. A breaking plan is refused whole; a failure stops and is recorded."""
    o = ontology_of(files)
    p = plan_ or plan(o, stores)
    history = History(stores)
    digest = content_hash(files)
    rows = history.rows()
    if not p.changes and rows and rows[-1]["content_hash"] == digest and rows[-1]["status"] == "applied":
        return Applied("up-to-date", rows[-1]["version"], p, [])
    if p.breaking:
        return Applied("refused", None, p, [], "the plan has breaking changes")
    wants, done, error = desired(o), [], None
    for catalog, table in p.tables():
        try:
            _apply_table(stores[catalog], table, wants[catalog, table], [c for c in p.changes if (c.catalog, c.table) == (catalog, table)], digest)
            done.append(table)
        except StrataError as e:
            error = f"{table}: {e}"
            break
    version = history.last() + 1
    summary = note + ("; ".join(c.text for c in p.changes) or "no change to tables")
    for catalog in dict.fromkeys(x.place.catalog for x in o.objects.values()):
        history.record(
            catalog, version=version, applied_at=now or datetime.now(timezone.utc), content_hash=digest, spec=json.dumps(dict(files)), summary=summary,
            status="partial" if error else "applied", library="0.1", actor=actor,
        )
    return Applied("partial" if error else "applied", version, p, done, error)


def _apply_table(store: TableStore, table: str, want: dict, changes: list, digest: str) -> None:
    notes = {"spec": digest}
    if any(c.op == "create" for c in changes):
        store.create(table, struct(want), notes)
        return
    fields = {f.name: f for f in struct(want)}
    store.alter(
        table,
        add=[fields[c.column] for c in changes if c.op == "add"],
        rename={c.old: c.column for c in changes if c.op == "rename"},
        promote={c.column: fields[c.column].dataType for c in changes if c.op == "promote"},
        loosen=[c.column for c in changes if c.op == "loosen"],
        notes=notes,
    )


def renames_between(rows: list[dict[str, Any]], version: int) -> dict[tuple[str, str], dict[str, str]]:
    """For every table, present column names to the names that they had at ``version``."""
    out: dict[tuple[str, str], dict[str, str]] = {}
    for r in (r for r in reversed(rows) if r["version"] > version):
        for t, columns in desired(ontology_of(json.loads(r["spec"]))).items():
            for w in columns.values():
                for f in w.former:
                    known = out.setdefault(t, {})
                    top = next((k for k, v in known.items() if v == w.name), w.name)
                    known[top] = f
    return out


def rollback(version: int, stores: Mapping[str, TableStore], root: str | Path | None = None, actor: str | None = None, now: datetime | None = None) -> tuple[Applied, list[str]]:
    """Apply an earlier version's spec again, renames turned back; and the columns left behind.

    Nothing is dropped. The spec files are put back last, when the tables are done.
    """
    history = History(stores)
    files = json.loads(history.at(version)["spec"])
    back = renames_between(history.rows(), version)
    o = ontology_of(files)
    objects = {}
    for name, x in o.objects.items():
        turned = {old: new for new, old in back.get(tuple(x.place), {}).items()}
        objects[name] = replace(x, props={n: replace(p, was=turned.get(p.column)) for n, p in x.props.items()})
    links = {}
    for name, link in o.links.items():
        turned = {old: new for new, old in back.get(tuple(link.via or ()), {}).items()}
        a, b = (replace(s, was=turned.get(s.column)) for s in link.sides)
        links[name] = replace(link, sides=(a, b))
    p = plan(replace(o, objects=objects, links=links), stores)
    left = [f"{t}.{c}" for t, cs in p.unmanaged.items() for c in cs]
    done = apply(files, stores, actor, now, f"rollback to {version}: ", p)
    if done.status in ("applied", "up-to-date") and root is not None:
        root = Path(root)
        for f in read_spec(root):
            if f not in files:
                (root / f).unlink()
        for f, text in files.items():
            (root / f).parent.mkdir(parents=True, exist_ok=True)
            (root / f).write_text(text)
    return done, left
