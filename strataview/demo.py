"""An ontology over the star-schema tables, used by the registered queries and the bench."""

from __future__ import annotations

from functools import lru_cache

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Ontology
from .operators.governance import Principal, Program, bind
from .plans.resolver import Resolver
from .sources.catalog import Catalog, ParquetCatalog, ViewCatalog
from .spec import from_documents

SPEC = """
- objectType: {apiName: Region, primaryKey: regionId, title: name, backing: {catalog: star, table: region}, searchable: [name], properties: [
    {name: regionId, type: int, column: r_regionkey, unique: true}, {name: name, type: string, column: r_name}]}
- objectType: {apiName: Nation, primaryKey: nationId, title: name, backing: {catalog: star, table: nation}, searchable: [name], properties: [
    {name: nationId, type: int, column: n_nationkey, unique: true}, {name: name, type: string, column: n_name}, {name: regionId, type: int, column: n_regionkey}]}
- objectType: {apiName: Customer, primaryKey: customerId, title: name, backing: {catalog: star, table: customer}, searchable: [name, segment], properties: [
    {name: customerId, type: long, column: c_custkey, unique: true}, {name: name, type: string, column: c_name},
    {name: nationId, type: int, column: c_nationkey}, {name: acctBal, type: double, column: c_acctbal, nullable: true},
    {name: segment, type: enum, values: [AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY], column: c_mktsegment, nullable: true}]}
- objectType: {apiName: Supplier, primaryKey: supplierId, title: name, backing: {catalog: star, table: supplier}, searchable: [name], properties: [
    {name: supplierId, type: long, column: s_suppkey, unique: true}, {name: name, type: string, column: s_name},
    {name: nationId, type: int, column: s_nationkey}, {name: acctBal, type: double, column: s_acctbal}]}
- objectType: {apiName: Part, primaryKey: partId, title: name, backing: {catalog: star, table: part}, searchable: [name, kind], properties: [
    {name: partId, type: long, column: p_partkey, unique: true}, {name: name, type: string, column: p_name}, {name: brand, type: string, column: p_brand},
    {name: kind, type: string, column: p_type}, {name: size, type: int, column: p_size}, {name: price, type: double, column: p_retailprice}]}
- objectType: {apiName: Order, primaryKey: orderId, title: orderId, backing: {catalog: star, table: orders}, searchable: [priority], properties: [
    {name: orderId, type: long, column: o_orderkey, unique: true}, {name: customerId, type: long, column: o_custkey},
    {name: status, type: enum, values: [F, O, P], column: o_orderstatus}, {name: total, type: double, column: o_totalprice},
    {name: orderedOn, type: date, column: o_orderdate}, {name: priority, type: string, column: o_orderpriority}]}
- objectType: {apiName: Event, primaryKey: eventId, title: eventId, backing: {catalog: star, table: events}, searchable: [eventType], properties: [
    {name: eventId, type: long, column: event_id, unique: true}, {name: userId, type: long, column: user_id},
    {name: eventType, type: enum, values: [click, error, purchase, signup, view], column: event_type}, {name: value, type: double, column: value}]}
- objectType: {apiName: Document, primaryKey: docId, title: docId, backing: {catalog: star, table: documents}, searchable: [source], properties: [
    {name: docId, type: long, column: doc_id, unique: true}, {name: lang, type: enum, values: [de, en, es, fr], column: lang},
    {name: source, type: string, column: source}, {name: chars, type: long, column: n_chars}]}
- objectType: {apiName: Label, primaryKey: docId, title: docId, backing: {catalog: star, table: labels}, searchable: [], properties: [
    {name: docId, type: long, column: doc_id, unique: true}, {name: quality, type: int, column: quality}, {name: toxic, type: int, column: toxic}]}
- linkType: {apiName: placedBy, cardinality: many_to_one, from: {objectType: Order, property: customerId}, to: {objectType: Customer, property: customerId}, reverseName: orders}
- linkType: {apiName: livesIn, cardinality: many_to_one, from: {objectType: Customer, property: nationId}, to: {objectType: Nation, property: nationId}, reverseName: customers}
- linkType: {apiName: inRegion, cardinality: many_to_one, from: {objectType: Nation, property: regionId}, to: {objectType: Region, property: regionId}, reverseName: nations}
- linkType: {apiName: basedIn, cardinality: many_to_one, from: {objectType: Supplier, property: nationId}, to: {objectType: Nation, property: nationId}, reverseName: suppliers}
- linkType: {apiName: contains, cardinality: many_to_many, from: {objectType: Order, property: orderId}, to: {objectType: Part, property: partId}, reverseName: orderedIn,
    through: {catalog: star, table: lineitem, fromColumn: l_orderkey, toColumn: l_partkey}}
- linkType: {apiName: supplies, cardinality: many_to_many, from: {objectType: Supplier, property: supplierId}, to: {objectType: Part, property: partId}, reverseName: suppliedBy,
    through: {catalog: star, table: lineitem, fromColumn: l_suppkey, toColumn: l_partkey}}
- linkType: {apiName: labelOf, cardinality: one_to_one, from: {objectType: Label, property: docId}, to: {objectType: Document, property: docId}, reverseName: label}
- linkType: {apiName: neighbours, cardinality: one_to_many, from: {objectType: Customer, property: nationId}, to: {objectType: Customer, property: nationId}}
- action:
    apiName: moveSegment
    targetObjectType: Customer
    operation: modify
    parameters: [{name: customer, type: objectRef, objectType: Customer}, {name: segment, type: enum, values: [AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY]}]
    validation: [{rule: "segment != object.segment", message: The customer is in that segment}]
    effects: [{modifyObject: {key: customer, set: {segment: segment}}}]
- action:
    apiName: shout
    targetObjectType: Customer
    operation: modify
    parameters: [{name: customer, type: objectRef, objectType: Customer}]
    effects: [{modifyObject: {key: "{{ customer }}", set: {name: "upper(object.name) + '!'"}}}]
- action:
    apiName: tag
    targetObjectType: Customer
    operation: modify
    parameters: [{name: customer, type: objectRef, objectType: Customer}, {name: number, type: long, required: false}]
    validation: [{rule: "number > 0", message: A tag is above zero}]
    effects: [{modifyObject: {key: customer, set: {name: "object.name + '#'"}}}]
- action:
    apiName: closeAccount
    targetObjectType: Customer
    operation: delete
    parameters: [{name: customer, type: objectRef, objectType: Customer}]
    effects: [{deleteObject: {key: customer}}]
- action:
    apiName: openAccount
    targetObjectType: Customer
    operation: create
    parameters: [{name: id, type: long}, {name: name, type: string}, {name: nation, type: int}, {name: segment, type: string}]
    effects: [{createObject: {set: {customerId: id, name: name, nationId: nation, segment: segment}}}]
"""
CLAIMS = {"dept": "string", "groups": "string[]"}


@lru_cache(1)
def ontology() -> Ontology:
    return from_documents(yaml.safe_load(SPEC))


def sparse(spark: SparkSession, sf_dir: str) -> Catalog:
    """The same tables, with nulls where a segment is MACHINERY or a balance is negative."""
    base = ParquetCatalog(spark, sf_dir)
    c = base.table("customer").withColumns(
        {
            "c_mktsegment": F.nullif("c_mktsegment", F.lit("MACHINERY")),
            "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
        }
    )
    return ViewCatalog({"customer": c, **{t: base.table(t) for t in ("orders", "nation", "region")}})


def resolver(spark: SparkSession, sf_dir: str, policies: list[dict] | None = None, claims: dict | None = None, nulls: bool = False) -> Resolver:
    catalog = sparse(spark, sf_dir) if nulls else ParquetCatalog(spark, sf_dir)
    program: Program = bind(policies or [], ontology(), CLAIMS)
    caller = None if claims is None else Principal.of(claims, CLAIMS)
    return Resolver(ontology(), {"star": catalog}, program.select(caller))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A governed page: a nation's visible customers with a balance in a range, one column withheld."""
    r = resolver(spark, sf_dir, [{"name": "no-balance", "objectType": "Customer", "mask": ["acctBal"]}, {"name": "no-machinery", "objectType": "Customer", "rows": "object.segment != 'MACHINERY'"}])
    return r.traverse("Nation", 7, "customers", limit=100)
