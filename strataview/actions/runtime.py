"""Running an action: bind, read, admit, validate, compute, commit, record.

The row is read at a named version and the commit asserts that version, so what was
validated is what is replaced. On a conflict the whole run is repeated from the read on,
``ATTEMPTS`` times at most, under one edit id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import functions as F

from ..errors import ConflictError, PolicyError, QueryError, StrataError, hint
from ..functions.columns import quoted
from ..functions.evaluate import EvalError, Scope, evaluate
from ..model import Action, Kind, Ontology
from ..operators.governance import OPEN, PolicySet
from ..sources.store import TableStore
from ..types import coerce
from .log import EditLog, dumps, stamp
from .result import Problem, Result

ATTEMPTS = 3
VERSION = "0.1"
_ADMITTED = "__admitted"


class Refusal(Exception):
    def __init__(self, problems: list[Problem], status: str = "refused"):
        self.problems, self.status = problems, status


def _refuse(code: str, message: str, **detail: Any) -> Refusal:
    return Refusal([Problem(code, message, detail)])


@dataclass
class Runtime:
    ontology: Ontology
    stores: Mapping[str, TableStore]
    policies: PolicySet = field(default_factory=lambda: OPEN)
    logs: Mapping[str, EditLog] = field(default_factory=dict)  # by catalog
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)

    def run(self, action: str, params: Mapping[str, Any], actor: str | None = None, dry_run: bool = False) -> Result:
        if action not in self.ontology.actions:
            raise QueryError(f"no action '{action}'{hint(action, self.ontology.actions)}")
        if not self.policies.decided:
            raise PolicyError("the policies aren't decided for a caller")
        a = self.ontology.actions[action]
        x = self.ontology.objects[a.target]
        out = Result("refused", action, uuid.uuid4().hex, x.name, a.does)
        bound: dict[str, Any] = {}
        last: dict[str, Any] | None = None
        try:
            bound = self._bind(a, params)
            out.key = self._key(a, x, bound)
            for out.attempts in range(1, ATTEMPTS + 1):
                try:
                    self._attempt(a, x, bound, out, actor, dry_run)
                    break
                except ConflictError as e:
                    seen = out.before
                    last = {"expected": e.expected, "found": e.found, "attempts": out.attempts, "changed": self._changed(x, out.key, seen)}
            else:
                raise Refusal([Problem("conflict", "the table changed on every attempt", {**(last or {}), "contended": not (last or {}).get("changed")})], "failed")
        except Refusal as r:
            out.status, out.problems = r.status, r.problems
        if out.key is not None and out.status != "previewed" and not (dry_run and out.status == "refused"):
            self._record(a, x, out, bound, actor)
        return out

    def _bind(self, a: Action, given: Mapping[str, Any]) -> dict[str, Any]:
        problems, out = [], {}
        for k in given:
            if k not in a.params:
                problems.append(Problem("unknown_parameter", f"no parameter '{k}'{hint(k, a.params)}"))
        for name, p in a.params.items():
            v = given.get(name, p.default)
            if v is None and p.required:
                problems.append(Problem("missing_parameter", f"parameter '{name}' is missing"))
                continue
            try:
                out[name] = coerce(p.type, v, self.ontology.objects, f"parameter '{name}'")
            except ValueError as e:
                problems.append(Problem("type_error", str(e)))
        if problems:
            raise Refusal(problems)
        return out

    def _value(self, node, scope: Scope) -> Any:
        try:
            return evaluate(node, scope)
        except (EvalError, ArithmeticError) as e:
            raise _refuse("expression_error", str(e)) from None

    def _key(self, a: Action, x: Kind, bound: dict[str, Any]) -> Any:
        node = a.key if a.key is not None else a.sets[x.key_name]
        try:
            key = coerce(x.key.type, self._value(node, Scope(bound, now=self.clock())), self.ontology.objects, x.key_name)
        except ValueError as err:
            raise _refuse("type_error", str(err)) from None
        if key is None:
            raise _refuse("type_error", f"{x.key_name} can't be null")
        return key

    def _read(self, x: Kind, key: Any, version: int | None) -> tuple[dict[str, Any] | None, bool]:
        """The whole physical row at a version, and whether the policies admit it."""
        if version is None:
            return None, False
        df = self.stores[x.place.catalog].table(x.place.table, version)
        same = quoted(x.key.column).eqNullSafe(F.lit(key).cast(x.key.type.spark()))
        rows = df.where(same).select("*", self.policies.admits(x).alias(_ADMITTED)).limit(2).collect()
        if len(rows) > 1:
            raise _refuse("ambiguous_key", f"several rows of {x.name} have the key {key!r}")
        if not rows:
            return None, False
        row = rows[0].asDict()
        return row, row.pop(_ADMITTED)

    def _shown(self, x: Kind, row: Mapping[str, Any] | None) -> dict[str, Any] | None:
        hidden = self.policies.masked(x.name)
        return None if row is None else {p.name: row.get(p.column) for p in x.props.values() if p.name not in hidden}

    def _attempt(self, a: Action, x: Kind, bound: dict[str, Any], out: Result, actor: str | None, dry_run: bool) -> None:
        store = self.stores[x.place.catalog]
        version = store.version(x.place.table)
        out.read_version, out.before, out.after = version, None, None
        row, admitted = self._read(x, out.key, version)
        if a.does == "create":
            if row is not None:
                raise _refuse("object_exists", f"{x.name} {out.key!r} already exists")
        elif row is None or not admitted:
            raise _refuse("object_not_found", f"there is no {x.name} {out.key!r}")
        scope = Scope(bound, None if row is None else {p.name: row.get(p.column) for p in x.props.values()}, now=self.clock())
        problems = []
        for r in a.rules:
            try:
                if (held := evaluate(r.holds, scope)) is not True:
                    problems.append(Problem("validation_failed", r.message) if held is False else Problem("expression_error", f"rule '{r.text}' gave no answer"))
            except (EvalError, ArithmeticError) as e:
                problems.append(Problem("expression_error", f"rule '{r.text}': {e}"))
        new = dict(row or {})
        for name, node in a.sets.items():
            p = x.props[name]
            try:
                v = coerce(p.type, evaluate(node, scope), self.ontology.objects, name)
                if v is None and not p.nullable:
                    raise ValueError(f"{name} can't be null")
                new[p.column] = v
            except (EvalError, ArithmeticError) as e:
                problems.append(Problem("expression_error", f"set {name}: {e}"))
            except ValueError as e:
                problems.append(Problem("type_error", str(e)))
        out.before = self._shown(x, row)
        if problems:
            raise Refusal(problems)
        out.after = None if a.does == "delete" else self._shown(x, new)
        if dry_run:
            out.status = "previewed"
            return
        notes = stamp(out.edit_id, a.name, actor)
        try:
            if a.does == "create":
                out.version = store.insert_row(x.place.table, new, version, notes)
            elif a.does == "modify":
                out.version = store.replace_row(x.place.table, x.key.column, out.key, new, version, notes)
            else:
                out.version = store.delete_row(x.place.table, x.key.column, out.key, version, notes)
        except ConflictError:
            raise
        except Exception as e:  # the storage's own error, told to the caller as it is
            raise Refusal([Problem("commit_failed", str(e)[:500])], "failed") from e
        out.status = "applied"

    def _changed(self, x: Kind, key: Any, seen: Mapping[str, Any] | None) -> list[str]:
        """Declared properties of the row that differ from what this run had read."""
        try:
            row, _ = self._read(x, key, self.stores[x.place.catalog].version(x.place.table))
        except Refusal:
            return []
        now = self._shown(x, row) or {}
        return [k for k in sorted({*now, *(seen or {})}) if now.get(k) != (seen or {}).get(k)]

    def _record(self, a: Action, x: Kind, out: Result, bound: dict[str, Any], actor: str | None) -> None:
        log = self.logs.get(x.place.catalog)
        if log is None:
            return
        first = out.problems[0] if out.problems else None
        try:
            log.record(
                edit_id=out.edit_id, recorded_at=self.clock(), action=a.name, operation=a.does, object_type=x.name, catalog=x.place.catalog, table=x.place.table,
                object_key=str(out.key), status=out.status, code=first.code if first else None, message=first.message if first else None, parameters=dumps(bound),
                before=dumps(out.before), after=dumps(out.after), actor=actor, principal=self.policies.claims.get("sub"), library=VERSION,
                attempts=out.attempts, read_version=out.read_version, commit_version=out.version,
            )
        except StrataError as e:
            out.problems.append(Problem("log_failed", str(e)))
        except Exception as e:  # a lost record must not hide what the commit did
            out.problems.append(Problem("log_failed", str(e)[:500]))
