"""A harbour: vessels and their voyages, as a specification, as tables, and in a store."""

from datetime import datetime, timezone
from decimal import Decimal

import yaml
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StringType, StructType, TimestampType

from strataview.sources.store import TableStore
from strataview.spec import from_documents

SPEC = """
- objectType:
    apiName: Vessel
    primaryKey: vesselId
    title: name
    backing: {catalog: main, table: port.vessels}
    searchable: [name, state]
    properties:
      - {name: vesselId, type: string, column: imo, unique: true}
      - {name: name, type: string, column: call_name, nullable: true}
      - {name: state, type: enum, values: [moored, loading, sailing, retired], column: state, nullable: true}
      - {name: tonnage, type: double, column: gross_tons, nullable: true}
- objectType:
    apiName: Voyage
    primaryKey: voyageId
    title: voyageId
    backing: {catalog: main, table: port.voyages}
    searchable: [voyageId]
    properties:
      - {name: voyageId, type: string, column: nr, unique: true}
      - {name: vesselId, type: string, column: imo}
      - {name: fare, type: decimal, precision: 12, scale: 2, column: fare_eur}
      - {name: leftAt, type: timestamp, column: left_at}
- linkType:
    apiName: sailedBy
    cardinality: many_to_one
    from: {objectType: Voyage, property: vesselId}
    to: {objectType: Vessel, property: vesselId}
    reverseName: voyages
- action:
    apiName: setState
    targetObjectType: Vessel
    operation: modify
    parameters: [{name: vessel, type: objectRef, objectType: Vessel}, {name: next, type: enum, values: [loading, sailing]}]
    validation: [{rule: "next != object.state", message: It is in that state already}]
    effects: [{modifyObject: {key: "{{ vessel }}", set: {state: "{{ next }}"}}}]
- action:
    apiName: scrap
    targetObjectType: Vessel
    operation: delete
    parameters: [{name: vessel, type: objectRef, objectType: Vessel}]
    effects: [{deleteObject: {key: vessel}}]
- action:
    apiName: depart
    targetObjectType: Voyage
    operation: create
    parameters: [{name: nr, type: string}, {name: vessel, type: objectRef, objectType: Vessel}, {name: fare, type: decimal, precision: 12, scale: 2}]
    effects: [{createObject: {set: {voyageId: nr, vesselId: vessel, fare: fare, leftAt: "now()"}}}]
- action:
    apiName: refit
    targetObjectType: Vessel
    operation: modify
    parameters: [{name: vessel, type: objectRef, objectType: Vessel}]
    validation: [{rule: "object.tonnage > 0", message: Nothing to refit}]
    effects: [{modifyObject: {key: vessel, set: {tonnage: "object.tonnage * 2"}}}]
"""
VESSELS = (
    StructType().add("imo", StringType(), False).add("call_name", StringType()).add("state", StringType())
    .add("gross_tons", DoubleType()).add("flag", StringType()).add("berths", ArrayType(StringType()))
)
VOYAGES = (
    StructType().add("nr", StringType(), False).add("imo", StringType(), False).add("fare_eur", DecimalType(12, 2), False).add("left_at", TimestampType(), False)
)
#: Nulls in every column but the key, a name that is a state, a lower-case name, equal and zero numbers.
FLEET = [
    ("v1", "Albatross", "sailing", 7200.5, "no", ["north 1", "north 2"]),
    ("v2", None, "loading", 310.0, "lv", None),
    ("v3", "Dunlin", None, None, None, []),
    ("v4", "loading", "loading", 12.0, "no", ["south 1"]),
    ("v5", "Curlew", "moored", None, None, None),
    ("v6", "avocet", "sailing", 99.5, "fr", ["north 2"]),
    ("v7", None, None, 0.0, "lv", None),
]


def day(n: int) -> datetime:
    return datetime(2026, 1, n, 12, tzinfo=timezone.utc)


TRIPS = [("t1", "v1", Decimal("820.40"), day(4)), ("t2", "v6", Decimal("75.10"), day(4)), ("t3", "v1", Decimal("1210.00"), day(6)), ("t4", "v2", Decimal("99.99"), day(6))]


def documents() -> list:
    return yaml.safe_load(SPEC)


def ontology():
    return from_documents(documents())


def store(spark, path) -> TableStore:
    s = TableStore(spark, path)
    for name, schema, rows in (("port.vessels", VESSELS, FLEET), ("port.voyages", VOYAGES, TRIPS)):
        s.create(name, schema)
        s.append(name, spark.createDataFrame(rows, schema))
    return s
