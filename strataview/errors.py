"""What can go wrong, and a collector that reports all of it at once."""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from dataclasses import dataclass, field


class StrataError(Exception):
    """Base of the library's own errors."""


class QueryError(StrataError):
    """A read that can't be answered as asked."""


class PolicyError(StrataError):
    """A policy that can't be applied, or a caller it can't be decided for."""


class ConflictError(StrataError):
    """A commit found another version than the one it was to replace."""

    def __init__(self, table: str, expected: int | None, found: int | None):
        super().__init__(f"{table}: expected version {expected}, found {found}")
        self.table, self.expected, self.found = table, expected, found


class SpecErrors(StrataError):
    """Every problem of a specification."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def error(self, where: str, text: str) -> None:
        self.errors.append(f"{where}: {text}")

    def warn(self, where: str, text: str) -> None:
        self.warnings.append(f"{where}: {text}")

    def check(self) -> None:
        if self.errors:
            raise SpecErrors(self.errors)


def hint(name: object, known: Iterable[str]) -> str:
    """`` (did you mean 'x'?)`` where a known name is close, else nothing."""
    close = difflib.get_close_matches(str(name), [str(k) for k in known], 1)
    return f" (did you mean '{close[0]}'?)" if close else ""
