"""The command line: validate, query, run, serve, plan, apply, rollback."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..actions.runtime import Runtime
from ..errors import Report, SpecErrors, StrataError
from ..migrate import apply, plan, rollback
from ..migrate.history import read_spec
from ..operators.governance import Principal
from ..plans.resolver import Resolver
from ..sources.store import TableStore
from ..spec import build
from ..validate import validate_physical
from . import config, negotiate
from .server import http_server, serve_stdio
from .tools import Tool, json_safe, tools


def session() -> SparkSession:
    spark = SparkSession.builder.appName("strataview").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataview")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, live: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("spec", help="folder of the specification")
        c.add_argument("--config", required=live, help="deployment file")
        return c

    command("validate", False).add_argument("--physical", action="store_true")
    q = command("query")
    q.add_argument("object_type")
    q.add_argument("--key")
    q.add_argument("--link")
    q.add_argument("--filter", action="append", default=[], metavar="P[.OP]=V")
    q.add_argument("--limit", type=int)
    r = command("run")
    r.add_argument("action")
    r.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    r.add_argument("--dry-run", action="store_true")
    command("serve")
    command("plan")
    for name in ("apply", "rollback"):
        c = command(name)
        c.add_argument("--yes", action="store_true")
        if name == "rollback":
            c.add_argument("--to", type=int, required=True)
    return p


def filters_of(pairs: Sequence[str]) -> dict[str, dict[str, str | None]]:
    """``P=V`` and ``P.OP=V``; the word null is a null."""
    out: dict[str, dict[str, str | None]] = {}
    for pair in pairs:
        left, eq, value = pair.partition("=")
        if not eq:
            raise StrataError(f"a filter is written P=V or P.OP=V, not '{pair}'")
        name, dot, op = left.partition(".")
        v = None if value == "null" else value
        if dot:
            got = out.setdefault(name, {})
            if not isinstance(got, dict):
                raise StrataError(f"'{name}' has both a bare value and operators")
            got[op] = v
        else:
            out[name] = v  # type: ignore[assignment]
    return out


def confirmed(yes: bool, text: str) -> bool:
    if yes:
        return True
    if not sys.stdin.isatty():
        print("not confirmed: pass --yes where there is no terminal")
        return False
    return input(f"{text} [y/N] ").strip().lower() in ("y", "yes")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args, spark)
    except SpecErrors as e:
        print("\n".join(f"error: {x}" for x in e.problems))
    except StrataError as e:
        print(f"error: {e}")
    return 1


def _run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    o, report = build(args.spec)
    for w in report.warnings:
        print(f"warning: {w}")
    if args.command == "validate" and not args.physical:
        print(f"{len(o.objects)} object types, {len(o.links)} links, {len(o.actions)} actions")
        return 0
    if not args.config:
        raise StrataError("--config is needed to look at tables")
    cfg = config.load(args.config)
    catalogs = cfg.open(spark or session())
    if args.command == "validate":
        live = Report()
        validate_physical(o, catalogs, live)
        for w in live.warnings:
            print(f"warning: {w}")
        live.check()
        print("the tables match")
        return 0
    stores = {k: c for k, c in catalogs.items() if isinstance(c, TableStore)}
    if args.command in ("plan", "apply", "rollback"):
        return _migrate(args, o, stores)
    negotiate.check(o)
    program, logs = cfg.program(o), cfg.logs(o, catalogs)

    def planes(caller: Principal | None) -> tuple[Resolver, Runtime]:
        """Reads and writes as one caller may make them."""
        policies = program.select(caller)
        return Resolver(o, catalogs, policies), Runtime(o, stores, policies, logs)

    def offer(caller: Principal | None) -> dict[str, Tool]:
        resolver, runtime = planes(caller)
        return tools(o, resolver, runtime if cfg.allow_writes else None)

    if args.command == "serve" and cfg.transport == "http":
        if cfg.auth is None:
            offer(None)  # what can't be decided without a caller is refused before the first one
        with http_server(cfg.name, offer, cfg.host, cfg.port, cfg.verifier()) as server:
            print(f"http://{cfg.host}:{server.server_port}/mcp", file=sys.stderr, flush=True)
            server.serve_forever()
        return 0
    if args.command == "serve":
        serve_stdio(cfg.name, offer(None), sys.stdin, sys.stdout)
        return 0
    resolver, runtime = planes(None)
    if args.command == "run":
        params = {k: None if v == "null" else v for k, _, v in (p.partition("=") for p in args.param)}
        result = runtime.run(args.action, params, dry_run=args.dry_run)
        print(json.dumps(json_safe(asdict(result)), default=str))
        return 0 if result.ok else 1
    if args.link:
        rows = resolver.traverse(args.object_type, args.key, args.link, args.limit).collect()
    elif args.key is not None:
        found = resolver.get(args.object_type, args.key)
        print(json.dumps(json_safe(found), default=str) if found else "not found")
        return 0 if found else 1
    else:
        rows = resolver.search(args.object_type, filters_of(args.filter), args.limit).collect()
    for r in rows:
        print(json.dumps(json_safe(r.asDict()), ensure_ascii=False, default=str))
    return 0


def _migrate(args: argparse.Namespace, o, stores: dict[str, TableStore]) -> int:
    if args.command == "rollback":
        if not confirmed(args.yes, f"Roll back to version {args.to}?"):
            return 1
        done, left = rollback(args.to, stores, args.spec)
        for c in left:
            print(f"left behind: {c}")
    else:
        p = plan(o, stores)
        print(p.render())
        if args.command == "plan":
            return 2 if p.breaking else 0
        if p.changes and not p.breaking and not confirmed(args.yes, "Apply?"):
            return 1
        done = apply(read_spec(args.spec), stores)
    print(f"{done.status}" + (f", version {done.version}" if done.version else "") + (f": {done.error}" if done.error else ""))
    return 0 if done.status in ("applied", "up-to-date") else 1


if __name__ == "__main__":
    sys.exit(main())
