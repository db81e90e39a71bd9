"""Versioned Parquet tables: snapshots, optimistic commits, columns addressed by id.

A table is a folder with ``data/`` files and ``versions/<n>.json`` manifests. A manifest
lists the version's files, the schema with a field id per column, its parent, and the
commit's own notes. A commit writes its files, then links a complete manifest to the next
number; linking fails if that number exists, so of two writers one loses and is told.
Readers name a version and see just that. Columns are read by field id, so renaming,
adding and loosening rewrite nothing. The folder must be on a POSIX file system.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..errors import ConflictError, QueryError
from ..functions.columns import quoted
from ..types import physical
from .catalog import Catalog

FIELD_ID = "parquet.field.id"
ATTEMPTS = 20  # of an append, which any other commit may outrun
#: Promotions that Parquet readers make by themselves; all others rewrite the files.
FREE = {("int", "long"), ("int", "double"), ("float", "double")}


class TableStore(Catalog):
    def __init__(self, spark: SparkSession, root: str | Path):
        path = str(root)
        self.spark, self.root = spark, Path("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
        for k in ("read", "write"):
            spark.conf.set(f"spark.sql.parquet.fieldId.{k}.enabled", "true")

    # Reading

    def _folder(self, name: str) -> Path:
        return self.root / name

    def version(self, name: str) -> int | None:
        found = [int(p.stem) for p in (self._folder(name) / "versions").glob("[0-9]*.json")]
        return max(found, default=None)

    def manifest(self, name: str, version: int | None = None) -> dict[str, Any]:
        version = self.version(name) if version is None else version
        if version is None:
            raise QueryError(f"table '{name}' doesn't exist")
        return json.loads((self._folder(name) / "versions" / f"{version}.json").read_text())

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.manifest(name)["schema"])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        m = self.manifest(name, version)
        schema = StructType.fromJson(m["schema"])
        if not m["files"]:
            return self.spark.createDataFrame([], schema)
        loose = StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema])
        return self.spark.read.schema(loose).parquet(*[str(self._folder(name) / "data" / f) for f in m["files"]])

    # Committing

    def _data(self, name: str, df: DataFrame, schema: StructType) -> list[str]:
        """Write rows as new files of the table; columns take their ids, required ones are checked."""
        part = uuid.uuid4().hex
        path = self._folder(name) / "data" / part
        columns = []
        for f in schema:
            c = quoted(f.name).cast(f.dataType)
            if not f.nullable:
                c = F.coalesce(c, F.raise_error(F.lit(f"{name}.{f.name} can't be null")).cast(f.dataType))
            columns.append(c.alias(f.name, metadata=f.metadata))
        df.select(*columns).write.parquet(str(path))
        return [f"{part}/{p.name}" for p in sorted(path.glob("*.parquet"))]

    def commit(self, name: str, files: Sequence[str], schema: StructType, parent: int | None, notes: Mapping[str, Any] | None = None) -> int:
        """Make a version out of files, if ``parent`` is still the present one."""
        versions = self._folder(name) / "versions"
        versions.mkdir(parents=True, exist_ok=True)
        number = 1 if parent is None else parent + 1
        if self.version(name) != parent:
            raise ConflictError(name, parent, self.version(name))
        body = {"version": number, "parent": parent, "schema": schema.jsonValue(), "files": list(files), "notes": dict(notes or {})}
        tmp = versions / f".{uuid.uuid4().hex}"
        tmp.write_text(json.dumps(body))
        try:
            os.link(tmp, versions / f"{number}.json")
        except FileExistsError:
            raise ConflictError(name, parent, self.version(name)) from None
        finally:
            tmp.unlink()
        return number

    def create(self, name: str, schema: StructType, notes: Mapping[str, Any] | None = None) -> int:
        fields = [StructField(f.name, f.dataType, f.nullable, {**f.metadata, FIELD_ID: i}) for i, f in enumerate(schema, 1)]
        return self.commit(name, [], StructType(fields), None, notes)

    def rows(self, name: str, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
        schema = self.schema(name)
        loose = StructType([StructField(f.name, f.dataType, True) for f in schema])
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], loose)

    def append(self, name: str, df: DataFrame, expect: int | None = None, notes: Mapping[str, Any] | None = None) -> int:
        """Add rows; with ``expect``, only to that version, else to whichever is present.

        Files are written once and offered again after a conflict, unless the schema has changed
        under them; ConflictError after ``ATTEMPTS`` tries.
        """
        files, written = [], None
        for attempt in range(1, ATTEMPTS + 1):
            base = self.version(name) if expect is None else expect
            m = self.manifest(name, base)
            if written != m["schema"]:
                self._discard(name, files)
                written = m["schema"]
                files = self._data(name, df, StructType.fromJson(written))
            try:
                return self.commit(name, [*m["files"], *files], StructType.fromJson(m["schema"]), base, notes)
            except ConflictError:
                if expect is not None or attempt == ATTEMPTS:
                    self._discard(name, files)
                    raise
        raise AssertionError

    def append_rows(self, name: str, rows: Sequence[Mapping[str, Any]], notes: Mapping[str, Any] | None = None) -> int:
        return self.append(name, self.rows(name, rows), None, notes)

    def insert_row(self, name: str, row: Mapping[str, Any], expect: int, notes: Mapping[str, Any] | None = None) -> int:
        return self.append(name, self.rows(name, [row]), expect, notes)

    def _without(self, name: str, version: int, key: str, value: Any) -> tuple[list[str], list[str]]:
        """Files that lack the key, kept as they are, and the rewritten rest of those that hold it."""
        m = self.manifest(name, version)
        hit = quoted(key).eqNullSafe(F.lit(value))
        df = self.table(name, version)
        if not m["files"]:
            return [], []
        held = {f"{Path(r[0]).parent.name}/{Path(r[0]).name}" for r in df.where(hit).select(F.input_file_name()).distinct().collect()}
        kept = [f for f in m["files"] if f not in held]
        if not held:
            return kept, []
        schema = StructType.fromJson(m["schema"])
        loose = StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema])
        rest = self.spark.read.schema(loose).parquet(*[str(self._folder(name) / "data" / f) for f in sorted(held)]).where(~hit)
        return kept, self._data(name, rest, schema)

    def replace_row(self, name: str, key: str, value: Any, row: Mapping[str, Any], expect: int, notes: Mapping[str, Any] | None = None) -> int:
        """Swap the row of a key for a whole new row, in one commit; only files that hold it are rewritten."""
        kept, rest = self._without(name, expect, key, value)
        schema = StructType.fromJson(self.manifest(name, expect)["schema"])
        new = self._data(name, self.rows(name, [row]), schema)
        return self._guarded(name, kept, [*rest, *new], schema, expect, notes)

    def delete_row(self, name: str, key: str, value: Any, expect: int, notes: Mapping[str, Any] | None = None) -> int:
        kept, rest = self._without(name, expect, key, value)
        return self._guarded(name, kept, rest, StructType.fromJson(self.manifest(name, expect)["schema"]), expect, notes)

    def overwrite(self, name: str, df: DataFrame, notes: Mapping[str, Any] | None = None) -> int:
        base = self.version(name)
        schema = StructType.fromJson(self.manifest(name, base)["schema"])
        return self._guarded(name, [], self._data(name, df, schema), schema, base, notes)

    def compact(self, name: str, most: int) -> int | None:
        """Rewrite a table of more than ``most`` files as few; the new version, None where nothing is done or another commit came first."""
        m = self.manifest(name)
        if len(m["files"]) <= most:
            return None
        schema = StructType.fromJson(m["schema"])
        files = self._data(name, self.table(name, m["version"]).coalesce(1), schema)
        try:
            return self.commit(name, files, schema, m["version"], {"compacted": len(m["files"])})
        except ConflictError:
            self._discard(name, files)
            return None

    def _guarded(self, name: str, kept: list[str], new: list[str], schema: StructType, expect: int | None, notes: Mapping[str, Any] | None) -> int:
        try:
            return self.commit(name, [*kept, *new], schema, expect, notes)
        except ConflictError:
            self._discard(name, new)
            raise

    def _discard(self, name: str, files: Sequence[str]) -> None:
        for part in {f.split("/")[0] for f in files}:
            shutil.rmtree(self._folder(name) / "data" / part, ignore_errors=True)

    # Changing the schema

    def alter(
        self, name: str, add: Sequence[StructField] = (), rename: Mapping[str, str] | None = None, promote: Mapping[str, Any] | None = None,
        loosen: Sequence[str] = (), notes: Mapping[str, Any] | None = None,
    ) -> int:
        """All changes of one table in one commit. Renames map old names to new ones."""
        base = self.version(name)
        m = self.manifest(name, base)
        rename, promote = dict(rename or {}), dict(promote or {})
        old = StructType.fromJson(m["schema"])
        fields, rewrite = [], False
        for f in old:
            new = rename.get(f.name, f.name)
            kind = promote.get(new, f.dataType)
            rewrite |= kind != f.dataType and (physical(f.dataType), physical(kind)) not in FREE
            fields.append(StructField(new, kind, f.nullable or new in loosen, f.metadata))
        top = max((f.metadata.get(FIELD_ID, 0) for f in old), default=0)
        top = max(top, m["notes"].get("last_field_id", 0))
        for i, f in enumerate(add, top + 1):
            fields.append(StructField(f.name, f.dataType, True if m["files"] else f.nullable, {FIELD_ID: i}))
        schema = StructType(fields)
        files = m["files"]
        if rewrite and files:
            df = self.table(name, base)
            df = df.select(*[quoted(f.name).alias(rename.get(f.name, f.name)) for f in old], *[F.lit(None).cast(f.dataType).alias(f.name) for f in add])
            files = self._data(name, df, schema)
        return self.commit(name, files, schema, base, notes)
