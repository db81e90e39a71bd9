"""The audit log: one row for every run that reached an object, in one fixed table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..errors import PolicyError
from ..sources.store import TableStore

TABLE = "strataview_meta.edits"
FILES = 64  # one is added by each run; beyond these they are put together
_TEXTS = (
    "action", "operation", "object_type", "catalog", "table", "object_key", "status", "code", "message",
    "parameters", "before", "after", "actor", "principal", "library",
)
SCHEMA = StructType(
    [
        StructField("edit_id", StringType(), False),
        StructField("recorded_at", TimestampType(), False),
        *[StructField(c, StringType()) for c in _TEXTS],
        StructField("attempts", LongType()),
        StructField("read_version", LongType()),
        StructField("commit_version", LongType()),
    ]
)


class EditLog:
    def __init__(self, store: TableStore, attested: bool = False):
        self.store = store
        if attested and store.exists(TABLE) and "principal" not in store.schema(TABLE).names:
            raise PolicyError("the edit log has no column for the principal")

    def ensure(self) -> None:
        if not self.store.exists(TABLE):
            self.store.create(TABLE, SCHEMA)

    def record(self, **row: Any) -> None:
        self.ensure()
        self.store.append_rows(TABLE, [row])
        self.store.compact(TABLE, FILES)

    def history(self) -> DataFrame:
        return self.store.table(TABLE).orderBy("recorded_at", "edit_id")


def stamp(edit_id: str, action: str, actor: str | None) -> dict[str, Any]:
    """What a data commit says of its run."""
    return {"edit_id": edit_id, "action": action, "actor": actor}


def plain(v: Any) -> Any:
    """A value as JSON carries it."""
    return v.isoformat() if hasattr(v, "isoformat") else str(v) if type(v).__name__ == "Decimal" else v.hex() if isinstance(v, (bytes, bytearray)) else v


def dumps(row: dict[str, Any] | None) -> str | None:
    return None if row is None else json.dumps({k: plain(v) for k, v in row.items()}, ensure_ascii=False, default=str)

