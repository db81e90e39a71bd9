"""Tools generated from a specification: a name, a JSON schema and a handler for each."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..actions.log import plain
from ..actions.runtime import Runtime
from ..errors import StrataError, hint
from ..model import Ontology
from ..plans.filters import json_schema
from ..plans.resolver import MAX_LIMIT, Resolver, page

PAGING = {"limit": {"type": "integer", "minimum": 1, "maximum": MAX_LIMIT}, "offset": {"type": "integer", "minimum": 0}}


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def json_safe(v: Any) -> Any:
    if isinstance(v, Mapping):
        return {k: json_safe(x) for k, x in v.items()}
    return [json_safe(x) for x in v] if isinstance(v, (list, tuple)) else plain(v)


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    schema: dict[str, Any]
    handler: Callable[[dict[str, Any]], Any]


def _closed(properties: dict[str, Any], required: list[str] | None = None) -> dict[str, Any]:
    return {"type": "object", "properties": properties, "required": required or [], "additionalProperties": False}


def envelope(df: DataFrame, resolver: Resolver, object_type: str, limit: int | None, offset: int | None) -> dict[str, Any]:
    """A page as a tool returns it. ``hasMore`` may be true on an exactly full last page."""
    n, o = page(limit, offset)
    objects = [json_safe(r.asDict()) for r in df.collect()]
    return {"count": len(objects), "limit": n, "offset": o, "hasMore": len(objects) == n, "masked": sorted(resolver.masked(object_type)), "objects": objects}


def tools(o: Ontology, resolver: Resolver, runtime: Runtime | None = None) -> dict[str, Tool]:
    """``get_``, ``search_`` and ``list_`` for every object type, ``traverse_`` where links leave it, ``run_`` for actions."""
    out: dict[str, Tool] = {}

    def add(name: str, text: str, schema: dict[str, Any], handler: Callable[[dict[str, Any]], Any]) -> None:
        if name in out:
            raise StrataError(f"two tools would be called '{name}'")
        out[name] = Tool(name, text, schema, handler)

    for x in o.objects.values():
        s, n, key = snake_case(x.name), x.name, {"key": x.key.type.json_schema()}

        def get(a: dict[str, Any], n: str = n) -> Any:
            found = resolver.get(n, a["key"])
            return {"found": found is not None, "masked": sorted(resolver.masked(n)), "object": json_safe(found) if found else None}

        add(f"get_{s}", f"One {n} by {x.key_name}.", _closed(key, ["key"]), get)
        add(
            f"search_{s}", f"{n} objects that meet all filters, by {x.key_name}.", _closed({"filters": json_schema(x, resolver.masked(n)), **PAGING}),
            lambda a, n=n: envelope(resolver.search(n, a.get("filters"), a.get("limit"), a.get("offset")), resolver, n, a.get("limit"), a.get("offset")),
        )
        add(
            f"list_{s}", f"{n} objects, by {x.key_name}.", _closed(dict(PAGING)),
            lambda a, n=n: envelope(resolver.list(n, a.get("limit"), a.get("offset")), resolver, n, a.get("limit"), a.get("offset")),
        )
        hops = resolver.hops(n)
        if hops:

            def traverse(a: dict[str, Any], n: str = n, hops: dict = hops) -> Any:
                df = resolver.traverse(n, a["key"], a["link"], a.get("limit"), a.get("offset"))
                return envelope(df, resolver, hops[a["link"]].far.kind, a.get("limit"), a.get("offset"))

            add(f"traverse_{s}", f"Objects one link away from a {n}.", _closed({**key, "link": {"type": "string", "enum": list(hops)}, **PAGING}, ["key", "link"]), traverse)
    for a in o.actions.values() if runtime else ():
        schema = {n: (o.objects[p.type.object_type].key.type if p.type.kind == "objectRef" else p.type).json_schema() for n, p in a.params.items()}
        need = [n for n, p in a.params.items() if p.required and p.default is None]

        def run(args: dict[str, Any], name: str = a.name) -> Any:
            args = dict(args)
            dry = bool(args.pop("dryRun", False))
            return json_safe(asdict(runtime.run(name, args, dry_run=dry)))

        add(f"run_{snake_case(a.name)}", a.about.text or f"Run {a.name}.", _closed({**schema, "dryRun": {"type": "boolean"}}, need), run)
    return out


def call(available: Mapping[str, Tool], name: str, args: Mapping[str, Any] | None) -> tuple[str, bool]:
    """The tool's JSON text, and whether the call never became a run."""
    args = dict(args or {})
    tool = available.get(name)
    if tool is None:
        return f"no tool '{name}'{hint(name, available)}", True
    known = tool.schema["properties"]
    problems = [f"unknown argument '{k}'{hint(k, known)}" for k in args if k not in known]
    problems += [f"argument '{k}' is missing" for k in tool.schema["required"] if k not in args and not name.startswith("run_")]
    if problems:
        return "; ".join(problems), True
    try:
        return json.dumps(tool.handler(args), ensure_ascii=False, default=str), False
    except StrataError as e:
        return str(e), True
