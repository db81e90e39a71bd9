"""The read verbs: get, list, search and traverse, each a DataFrame over governed tables.

Every table of a plan is first the governed view of it, so a row that is withheld can't
be returned, counted by a page, or walked from. Projection comes last and leaves masked
properties out of the scan altogether.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, hint
from ..functions.columns import quoted
from ..model import Kind, Ontology, Walk
from ..operators.governance import OPEN, PolicySet
from ..sources.catalog import Catalog
from ..types import coerce
from .filters import conditions

DEFAULT_LIMIT, MAX_LIMIT = 50, 500


def page(limit: int | None, offset: int | None) -> tuple[int, int]:
    n = DEFAULT_LIMIT if limit is None else limit
    if n < 1:
        raise QueryError("limit must be 1 or more")
    if (offset or 0) < 0:
        raise QueryError("offset must be 0 or more")
    return min(n, MAX_LIMIT), offset or 0


@dataclass
class Resolver:
    ontology: Ontology
    catalogs: Mapping[str, Catalog]
    policies: PolicySet = field(default_factory=lambda: OPEN)

    def object_type(self, name: str) -> Kind:
        if name not in self.ontology.objects:
            raise QueryError(f"no object type '{name}'{hint(name, self.ontology.objects)}")
        return self.ontology.objects[name]

    def masked(self, object_type: str) -> frozenset[str]:
        return self.policies.masked(object_type)

    def governed(self, x: Kind) -> DataFrame:
        """The table as this caller may see it, all physical columns included."""
        df = self.catalogs[x.place.catalog].table(x.place.table)
        rule = self.policies.rows(x)
        return df if rule is None else df.where(rule)

    def projection(self, x: Kind, alias: str = "") -> list:
        hidden = self.masked(x.name)
        at = (lambda c: F.col(f"{alias}.`{c.replace('`', '``')}`")) if alias else quoted
        return [at(p.column).alias(p.name) for p in x.props.values() if p.name not in hidden]

    def _key(self, x: Kind, key: Any) -> Any:
        try:
            v = coerce(x.key.type, key, self.ontology.objects, x.key_name)
        except ValueError as e:
            raise QueryError(str(e)) from None
        if v is None:
            raise QueryError(f"{x.key_name}: a key can't be null")
        return v

    def get_frame(self, object_type: str, key: Any) -> DataFrame:
        """The row of a key: none, one, or two where the key isn't unique."""
        x = self.object_type(object_type)
        k = F.lit(self._key(x, key)).cast(x.key.type.spark())
        return self.governed(x).where(quoted(x.key.column) == k).limit(2).select(*self.projection(x))

    def get(self, object_type: str, key: Any) -> dict[str, Any] | None:
        rows = self.get_frame(object_type, key).collect()
        if len(rows) > 1:
            raise QueryError(f"{object_type}.{self.object_type(object_type).key_name} isn't unique: {key!r} has several rows")
        return rows[0].asDict() if rows else None

    def list(self, object_type: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self.search(object_type, {}, limit, offset)

    def search(self, object_type: str, filters: Mapping[str, Any] | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        x = self.object_type(object_type)
        n, o = page(limit, offset)
        df = self.governed(x)
        for c in conditions(x, filters or {}, self.masked(object_type)):
            df = df.where(c)
        return df.orderBy(quoted(x.key.column).asc_nulls_last()).offset(o).limit(n).select(*self.projection(x))

    def hops(self, object_type: str) -> dict[str, Walk]:
        """All links that leave an object type, by the name under which they do."""
        return {w.name: w for link in self.ontology.links.values() for w in link.walks() if w.near.kind == object_type}

    def traverse(self, object_type: str, key: Any, link: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """The objects one hop away. A mapping table's repeated rows repeat their objects."""
        x = self.object_type(object_type)
        n, o = page(limit, offset)
        hops = self.hops(object_type)
        if link not in hops:
            raise QueryError(f"no link '{link}' leaves {object_type}{hint(link, hops)}; there are {', '.join(hops) or 'none'}")
        hop = hops[link]
        y = self.object_type(hop.far.kind)
        k = F.lit(self._key(x, key)).cast(x.key.type.spark())
        side = lambda a, c: F.col(f"{a}.`{c.replace('`', '``')}`")
        anchor = self.governed(x).where(quoted(x.key.column) == k).alias("t1")
        to = self.governed(y).alias("t0")
        a, b = side("t1", x.props[hop.near.prop].column), side("t0", y.props[hop.far.prop].column)
        if hop.via:
            m = self.catalogs[hop.via.catalog].table(hop.via.table).alias("m0")
            joined = to.join(m, b == side("m0", hop.far.column)).join(anchor, side("m0", hop.near.column) == a)
        else:
            joined = to.join(anchor, a == b)
        return joined.orderBy(side("t0", y.key.column).asc_nulls_last()).offset(o).limit(n).select(*self.projection(y, "t0"))
