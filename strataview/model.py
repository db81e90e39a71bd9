"""What a specification declares, in the shape in which the engine walks it.

Everything is found by name: kinds, links and actions in an :class:`Ontology`, properties in
their kind. A link has two sides that are alike; each knows the property it joins on and, where
a mapping table lies between, its own column there. So walking a link is no more than a choice
of the near side, and neither way is special.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from .functions.expr import Node
from .types import PropType


class Place(NamedTuple):
    """A table, and the catalog that has it."""

    catalog: str
    table: str


class About(NamedTuple):
    label: str = ""
    text: str = ""
    status: str = "active"


@dataclass(frozen=True)
class Prop:
    """A property and the column that stores it; ``was`` is the column's former name."""

    column: str
    name: str
    type: PropType
    flags: frozenset[str] = frozenset()  # of nullable, unique
    was: str | None = None
    text: str = ""

    @property
    def nullable(self) -> bool:
        return "nullable" in self.flags

    @property
    def unique(self) -> bool:
        return "unique" in self.flags


@dataclass(frozen=True)
class Kind:
    """A kind of object: rows of one table, told apart by the property ``key_name``."""

    name: str
    place: Place
    props: Mapping[str, Prop]
    key_name: str
    title: str
    search: tuple[str, ...] = ()
    about: About = About()

    @property
    def key(self) -> Prop:
        return self.props[self.key_name]


@dataclass(frozen=True)
class Side:
    kind: str
    prop: str
    column: str | None = None  # in the mapping table, with its former name
    was: str | None = None


class Walk(NamedTuple):
    """A link as seen from the side it is walked from."""

    name: str
    near: Side
    far: Side
    via: Place | None


@dataclass(frozen=True)
class Link:
    name: str
    cardinality: str
    sides: tuple[Side, Side]
    back: str | None = None  # its name from the second side
    via: Place | None = None
    about: About = About()

    def walks(self) -> Iterator[Walk]:
        a, b = self.sides
        yield Walk(self.name, a, b, self.via)
        if self.back:
            yield Walk(self.back, b, a, self.via)


class Rule(NamedTuple):
    holds: Node
    text: str
    message: str


@dataclass(frozen=True)
class Action:
    """One change of one object: its key (for a new object, among ``sets``) and what is set."""

    name: str
    does: str  # create, modify, delete
    target: str
    params: Mapping[str, Param]
    sets: Mapping[str, Node]
    key: Node | None = None
    rules: tuple[Rule, ...] = ()
    about: About = About()

    def nodes(self) -> Iterator[Node]:
        """Every expression in it."""
        yield from (r.holds for r in self.rules)
        yield from self.sets.values()
        if self.key is not None:
            yield self.key


@dataclass(frozen=True)
class Param:
    type: PropType
    required: bool = True
    default: Any = None
    text: str = ""


@dataclass(frozen=True)
class Ontology:
    objects: dict[str, Kind] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)
    actions: dict[str, Action] = field(default_factory=dict)
