"""What became of an action's run."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

STATUSES = ("applied", "previewed", "refused", "failed")
CODES = (
    "unknown_parameter", "missing_parameter", "type_error", "object_not_found", "object_exists", "ambiguous_key",
    "validation_failed", "expression_error", "conflict", "commit_failed", "log_failed",
)


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    detail: dict[str, Any] = field(default_factory=dict)

    @property
    def retryable(self) -> bool:
        return self.code == "conflict"


@dataclass
class Result:
    status: str
    action: str
    edit_id: str
    object_type: str
    operation: str
    key: Any = None
    before: dict[str, Any] | None = None
    after: dict[str, Any] | None = None
    problems: list[Problem] = field(default_factory=list)
    attempts: int = 1
    read_version: int | None = None
    version: int | None = None

    @property
    def ok(self) -> bool:
        return self.status in ("applied", "previewed")
