"""The batch rollup: a day's exact sum, count and distinct customers, with provenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, LongType, StringType, StructField, StructType, TimestampType

from ..errors import QueryError
from ..sources.store import TableStore

SCHEMA = StructType(
    [
        StructField("sales_date", DateType(), False),
        StructField("gross_sales", DecimalType(14, 2), False),
        StructField("order_count", LongType(), False),
        StructField("unique_customers", LongType(), False),
        StructField("refreshed_at", TimestampType(), False),
        StructField("source_table", StringType(), False),
        StructField("source_snapshot_id", LongType(), False),
    ]
)


def utc_day(at: Column, kind: DataType) -> Column:
    """The calendar day in UTC. A timestamp without a zone, or a date, has its day already."""
    return F.to_date(F.to_utc_timestamp(at, F.current_timezone()) if isinstance(kind, TimestampType) else at)


def daily(orders: DataFrame, at: Column, amount: Column, customer: Column) -> DataFrame:
    """Per calendar day (UTC): ``sales_date, gross_sales, order_count, unique_customers``.

    Sums and distinct counts are exact; a null customer counts as one. Two partial
    aggregations on (day, customer) and then day, so no day meets in one task whole.
    """
    kind = orders.select(at.alias("at")).schema["at"].dataType
    by_customer = (
        orders.select(utc_day(at, kind).alias("sales_date"), amount.cast("decimal(12,2)").alias("amount"), customer.alias("customer"))
        .groupBy("sales_date", "customer").agg(F.sum("amount").alias("gross"), F.count(F.lit(1)).alias("n"))
    )
    return by_customer.groupBy("sales_date").agg(
        F.sum("gross").cast("decimal(14,2)").alias("gross_sales"),
        F.sum("n").alias("order_count"),
        F.count(F.lit(1)).alias("unique_customers"),
    )


def refresh(store: TableStore, source: str, target: str, now: datetime, at: str = "created_at", amount: str = "total_amount", customer: str = "customer_id") -> int:
    """Recompute the rollup from the source's present version and replace it whole; the new version."""
    if now.tzinfo is None:
        raise QueryError("the refresh time needs a time zone")
    version = store.version(source)
    if version is None:
        raise QueryError(f"'{source}' has no version to read")
    rows = daily(store.table(source, version), F.col(at), F.col(amount), F.col(customer))
    rows = rows.withColumns({"refreshed_at": F.lit(now), "source_table": F.lit(source), "source_snapshot_id": F.lit(version).cast("long")})
    if not store.exists(target):
        store.create(target, SCHEMA)
    return store.overwrite(target, rows.orderBy("sales_date"))
