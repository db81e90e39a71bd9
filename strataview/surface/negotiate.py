"""What a specification needs of an engine, against what the engine can do."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import StrataError
from ..model import Ontology


@dataclass(frozen=True)
class Capabilities:
    name: str
    joins: bool = True
    offset: bool = True
    case_insensitive_like: bool = True
    native_merge: bool = False


SPARK = Capabilities("spark")


def requirements(o: Ontology) -> dict[str, str]:
    """Each needed capability, with the first declaration that needs it."""
    out = {"offset": f"paging of {next(iter(o.objects))}"} if o.objects else {}
    for x in o.objects.values():
        if any(x.props[s].type.kind == "string" for s in x.search):
            out.setdefault("case_insensitive_like", f"searchable strings of {x.name}")
    for link in o.links.values():
        out.setdefault("joins", f"link {link.name}")
    return out


def unmet(o: Ontology, c: Capabilities = SPARK) -> list[str]:
    return [f"{c.name} lacks '{need}', which {why} needs" for need, why in requirements(o).items() if not getattr(c, need)]


def check(o: Ontology, c: Capabilities = SPARK) -> None:
    if problems := unmet(o, c):
        raise StrataError("\n".join(problems))
