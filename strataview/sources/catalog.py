"""Catalogs: named sets of tables, each a DataFrame.

Scans are plain DataFrames. Projection and conditions are added where they are declared
and reach Parquet by Catalyst's own pruning and pushdown.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import quoted


class Catalog(ABC):
    """What a read needs; writable catalogs add more (see ``store``)."""

    @abstractmethod
    def table(self, name: str, version: int | None = None) -> DataFrame: ...

    @abstractmethod
    def exists(self, name: str) -> bool: ...

    def schema(self, name: str) -> StructType:
        return self.table(name).schema

    def version(self, name: str) -> int | None:
        """The present version's number; None where the table has no history."""
        return None

    def scan(self, name: str, columns: Sequence[str] | None = None, equal: Sequence[tuple[str, Any]] = (), limit: int | None = None) -> DataFrame:
        """Rows with all the given values, a null value matching nulls."""
        df = self.table(name)
        for c, v in equal:
            df = df.where(quoted(c).isNull() if v is None else quoted(c).eqNullSafe(F.lit(v)))
        if columns is not None:
            df = df.select(*map(quoted, columns))
        return df if limit is None else df.limit(limit)


class ParquetCatalog(Catalog):
    """Every ``<name>.parquet`` below a folder that Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def exists(self, name: str) -> bool:
        try:
            self.table(name)
        except AnalysisException:
            return False
        return True


class SparkCatalog(Catalog):
    """Tables of the session's own catalog, whatever format they have."""

    def __init__(self, spark: SparkSession, namespace: str = ""):
        self.spark, self.prefix = spark, f"{namespace}." if namespace else ""

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.table(self.prefix + name)

    def exists(self, name: str) -> bool:
        try:
            return self.spark.catalog.tableExists(self.prefix + name)
        except AnalysisException:
            return False


class ViewCatalog(Catalog):
    """DataFrames under names, for derived tables and tests."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.frames[name]

    def exists(self, name: str) -> bool:
        return name in self.frames
