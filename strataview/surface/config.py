"""The deployment file: catalogs, engine, tools and governance.

``catalogs.<name>.type`` is ``parquet`` (a folder of ``<table>.parquet``, read only),
``store`` (versioned tables) or ``spark`` (the session's own catalog). Paths are relative
to the file.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession

from ..actions.log import EditLog
from ..errors import PolicyError, Report, hint
from ..model import Ontology
from ..operators.governance import Program, bind
from ..sources.catalog import Catalog, ParquetCatalog, SparkCatalog
from ..sources.store import TableStore
from .auth import KeySet, Verifier

KEYS = {
    "": ("version", "catalogs", "engine", "mcp", "governance"),
    "catalog": ("type", "path", "namespace"),
    "engine": ("type",),
    "mcp": ("name", "transport", "host", "port", "allow_writes", "auth"),
    "auth": ("issuer", "audience", "jwks_uri", "claims", "clock_skew"),
    "governance": ("edit_log", "policies"),
}
CATALOGS = ("parquet", "store", "spark")
CLAIM_KINDS = ("string", "boolean", "int", "long", "double", "string[]")
LOOPBACK = ("127.0.0.1", "localhost", "::1")
MOST_SKEW = 300


@dataclass
class Config:
    catalogs: dict[str, dict[str, Any]]
    name: str = "strataview"
    transport: str = "stdio"
    host: str = "127.0.0.1"
    port: int = 8765
    allow_writes: bool = False
    auth: dict[str, Any] | None = None
    claims: dict[str, str] = field(default_factory=dict)
    edit_log: str = "optional"
    policies: list[dict[str, Any]] = field(default_factory=list)

    def open(self, spark: SparkSession) -> dict[str, Catalog]:
        make = {
            "parquet": lambda c: ParquetCatalog(spark, c["path"]),
            "store": lambda c: TableStore(spark, c["path"]),
            "spark": lambda c: SparkCatalog(spark, c.get("namespace", "")),
        }
        return {k: make[c["type"]](c) for k, c in self.catalogs.items()}

    def program(self, o: Ontology) -> Program:
        return bind(self.policies, o, self.claims)

    def verifier(self) -> Verifier | None:
        if self.auth is None:
            return None
        return Verifier(self.auth["issuer"], self.auth["audience"], KeySet(self.auth["jwks_uri"]), self.claims, self.auth.get("clock_skew", 0))

    def logs(self, o: Ontology, catalogs: Mapping[str, Catalog]) -> dict[str, EditLog]:
        """One edit log in each versioned store, for the writes that go there.

        Where the deployment demands the log, it is made now in every catalog that an action
        writes to, and a catalog that can't hold one is refused.
        """
        out = {k: EditLog(c, self.auth is not None) for k, c in catalogs.items() if isinstance(c, TableStore)}
        if self.edit_log == "required":
            for name in sorted({o.objects[a.target].place.catalog for a in o.actions.values()}):
                if name not in out:
                    raise PolicyError(f"edit_log is required, and catalog '{name}' can't hold one")
                out[name].ensure()
            if not out:
                raise PolicyError("edit_log is required, and no catalog can hold one")
        return out


def load(path: str | Path) -> Config:
    path = Path(path)
    return parse(yaml.safe_load(path.read_text()) or {}, path.parent)


def parse(raw: Mapping[str, Any], base: Path = Path(".")) -> Config:
    report = Report()

    def known(where: str, kind: str, d: Any) -> dict[str, Any]:
        if not isinstance(d, Mapping):
            report.error(where, "must be a mapping")
            return {}
        for k in d:
            if k not in KEYS[kind]:
                report.error(where, f"unknown key '{k}'{hint(k, KEYS[kind])}")
        return dict(d)

    top = known("deployment", "", raw)
    out = Config({})
    for name, c in (top.get("catalogs") or {}).items():
        c = known(f"catalog {name}", "catalog", c)
        if c.get("type") not in CATALOGS:
            report.error(f"catalog {name}", f"type must be one of {', '.join(CATALOGS)}{hint(c.get('type'), CATALOGS)}")
        elif c["type"] != "spark":
            if not c.get("path"):
                report.error(f"catalog {name}", "'path' is missing")
            elif "://" not in c["path"]:
                c["path"] = str((base / c["path"]).resolve())
        out.catalogs[name] = c
    if not out.catalogs:
        report.error("deployment", "no catalogs are declared")
    if known("engine", "engine", top.get("engine") or {}).get("type", "spark") != "spark":
        report.error("engine", "the type is spark")
    mcp = known("mcp", "mcp", top.get("mcp") or {})
    out.name, out.transport, out.host = mcp.get("name", out.name), mcp.get("transport", "stdio"), mcp.get("host", out.host)
    out.allow_writes = bool(mcp.get("allow_writes", False))
    if out.transport not in ("stdio", "http"):
        report.error("mcp", "transport must be stdio or http")
    out.port = mcp.get("port", out.port)
    if not isinstance(out.port, int) or isinstance(out.port, bool) or not 0 <= out.port < 1 << 16:
        report.error("mcp", "port must be a number below 65536")
    if "auth" in mcp:
        out.auth = auth = known("auth", "auth", mcp["auth"])
        for k in ("issuer", "audience", "jwks_uri"):
            if not isinstance(auth.get(k), str) or not auth[k]:
                report.error("auth", f"'{k}' is missing")
        skew = auth.get("clock_skew", 0)
        if not isinstance(skew, (int, float)) or isinstance(skew, bool) or not 0 <= skew <= MOST_SKEW:
            report.error("auth", f"clock_skew must be 0 to {MOST_SKEW} seconds")
        uri = str(auth.get("jwks_uri") or "")
        if uri.startswith("http://") and uri.split("/")[2].split(":")[0] not in LOOPBACK:
            report.error("auth", "jwks_uri must be https, unless it is on a loopback host")
        if out.transport != "http":
            report.error("auth", "standard streams carry no token; auth goes with transport http")
        out.claims = dict(auth.get("claims") or {})
        for k, v in out.claims.items():
            if v not in CLAIM_KINDS:
                report.error("auth", f"claim '{k}' must be one of {', '.join(CLAIM_KINDS)}")
    if out.transport == "http" and out.allow_writes and out.auth is None and out.host not in LOOPBACK:
        report.error("mcp", "writes over http need authentication, or a loopback host")
    g = known("governance", "governance", top.get("governance") or {})
    out.edit_log, out.policies = g.get("edit_log", "optional"), list(g.get("policies") or [])
    if out.edit_log not in ("optional", "required"):
        report.error("governance", "edit_log must be optional or required")
    report.check()
    return out
