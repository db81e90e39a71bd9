"""Registered queries whose answers are verdicts: refusals, runs of actions, migrations, tools.

Each returns a table (item, verdict). Beside it stands what it must be, as SQL values that
are written here and not computed; reads and post-images have SQL over the tables instead.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import demo
from .actions.log import EditLog
from .actions.runtime import Runtime
from .errors import PolicyError, Report, StrataError
from .functions.expr import FUNCTIONS, parse
from .migrate import apply, plan, rollback
from .migrate.history import History
from .operators import rollup
from .operators.governance import Principal, bind
from .plans.filters import conditions, json_schema, operators
from .plans.resolver import Resolver
from .queries import PLAIN, _folder, _stored, add
from .sources.catalog import Catalog, ParquetCatalog, ViewCatalog
from .sources.store import TableStore
from .spec import from_documents
from .surface import auth, cli, config, negotiate
from .surface.server import answer
from .surface.tools import call, snake_case, tools
from .validate import infer, validate_physical

Rows = Iterable[tuple[str, object]]
NOW = datetime(2026, 1, 4, 12, tzinfo=timezone.utc)


def verdicts(name: str, make: Callable[[SparkSession, str], Rows], want: dict[str, object]) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in make(spark, d)], "item string, verdict string")

    quoted = lambda v: "'" + str(v).replace("'", "''") + "'"
    add(name, query, f"SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in want.items())}) t(item, verdict)")


def tried(f: Callable[[], Any]) -> str:
    """What a call gives, or why it was refused: the last problem's last part."""
    try:
        return str(f())
    except StrataError as e:
        return "refused: " + str(e).splitlines()[-1].rpartition(": ")[2]


def _runtime(spark: SparkSession, d: str, policies: list[dict] | None = None, store: TableStore | None = None, log: bool = False) -> tuple[Runtime, TableStore]:
    o = demo.ontology()
    store = store or _stored(spark, d, "customer", ParquetCatalog(spark, d).table("customer"))
    logs = {"star": EditLog(store)} if log else {}
    return Runtime(o, {"star": store}, bind(policies or [], o).select(), logs, clock=lambda: NOW), store


# Actions: whole post-images, with SQL over the table


def _after(action: str, **params: Any) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rt, store = _runtime(spark, d)
        rt.run(action, params)
        return store.table("customer").select(*PLAIN.split(", "))

    return query


add("action_modify_post_image", _after("moveSegment", customer=5, segment="FURNITURE"), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey = 5 THEN 'FURNITURE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add("action_effect_expression", _after("shout", customer=7), "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN upper(c_name) || '!' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
add("action_delete_post_image", _after("closeAccount", customer=5), f"SELECT {PLAIN} FROM customer WHERE c_custkey <> 5")
add("action_create_post_image", _after("openAccount", id=-1, name="New", nation=3, segment="BUILDING"), f"SELECT {PLAIN} FROM customer UNION ALL SELECT -1, 'New', 3, NULL, 'BUILDING'")
add("action_refused_post_image", _after("closeAccount", customer=-7), f"SELECT {PLAIN} FROM customer")


def _runs(spark: SparkSession, d: str) -> Rows:
    rt, store = _runtime(spark, d)
    twice = store.table("customer").where("c_custkey = 9")
    store.append("customer", twice)
    before = store.version("customer")

    def said(action: str, dry: bool = False, runtime: Runtime = rt, **params: Any) -> str:
        r = runtime.run(action, params, dry_run=dry)
        return " ".join([r.status, *(p.code for p in r.problems)])

    yield "unknown parameter", said("closeAccount", customer=5, why="x")
    yield "missing parameter", said("closeAccount")
    yield "null parameter", said("closeAccount", customer=None)
    yield "wrong type", said("closeAccount", customer="five")
    yield "not of the enum", said("moveSegment", customer=5, segment="GARDEN")
    yield "all problems at once", said("moveSegment", customer="five", segment="GARDEN", x=1)
    yield "absent object", said("closeAccount", customer=-7)
    yield "existing object", said("openAccount", id=5, name="x", nation=1, segment="BUILDING")
    yield "doubled key", said("closeAccount", customer=9)
    yield "rule without an answer", said("tag", customer=5, number=None)
    yield "rule that fails", said("tag", customer=5, number=-1)
    yield "key that can't be null", said("openAccount", id=None, name="x", nation=1, segment="BUILDING")
    yield "preview", said("closeAccount", True, customer=5)
    yield "preview of a refusal", said("closeAccount", True, customer=-7)
    hidden, _ = _runtime(spark, d, [{"name": "p", "objectType": "Customer", "rows": "object.customerId > 5"}], store)
    yield "withheld object", said("closeAccount", False, hidden, customer=5)
    yield "nothing was written", store.version("customer") == before
    yield "unknown action", tried(lambda: rt.run("closeAcount", {}))
    yield "policies not decided", tried(lambda: Runtime(rt.ontology, rt.stores, replace(rt.policies, decided=False)).run("closeAccount", {"customer": 5}))


verdicts("action_verdicts", _runs, {
    "unknown parameter": "refused unknown_parameter", "missing parameter": "refused missing_parameter", "null parameter": "refused missing_parameter", "wrong type": "refused type_error",
    "not of the enum": "refused type_error", "all problems at once": "refused unknown_parameter type_error type_error", "absent object": "refused object_not_found",
    "existing object": "refused object_exists", "doubled key": "refused ambiguous_key", "rule without an answer": "refused expression_error",
    "rule that fails": "refused validation_failed", "key that can't be null": "refused missing_parameter", "preview": "previewed", "preview of a refusal": "refused object_not_found",
    "withheld object": "refused object_not_found", "nothing was written": "True", "unknown action": "refused: no action 'closeAcount' (did you mean 'closeAccount'?)",
    "policies not decided": "refused: the policies aren't decided for a caller",
})


class _Rival(TableStore):
    """Another writer that changes the row before each of the first ``times`` replacements."""

    times, change = 0, {"c_name": "Rival"}

    def replace_row(self, name, key, value, row, expect, notes=None):
        if self.times:
            self.times -= 1
            now = self.table(name).where(F.col(key) == value).first().asDict()
            super().replace_row(name, key, value, {**now, **self.change, "c_acctbal": float(self.times)}, self.version(name))
        return super().replace_row(name, key, value, row, expect, notes)


def _races(spark: SparkSession, d: str) -> Rows:
    small = ParquetCatalog(spark, d).table("customer").where("c_custkey < 20").withColumn("c_mktsegment", F.lit("MACHINERY"))

    def against(times: int, change: dict | None = None) -> tuple[Any, TableStore]:
        store = _Rival(spark, _stored(spark, d, "customer", small).root)
        store.times, store.change = times, change or store.change
        rt, _ = _runtime(spark, d, None, store, True)
        return rt.run("moveSegment", {"customer": 5, "segment": "BUILDING"}), store

    r, store = against(1)
    row = store.table("customer").where("c_custkey = 5").first()
    yield "retried on fresh values", f"{r.status} after {r.attempts}, {row.c_name}, {row.c_mktsegment}"
    r, _ = against(1, {"c_mktsegment": "BUILDING"})
    yield "the rival's change decides", f"{r.status} after {r.attempts}, {r.problems[0].code}"
    r, store = against(9)
    p = r.problems[0]
    yield "three attempts", f"{r.status} after {r.attempts}, {p.code}, retryable {p.retryable}"
    yield "conflict detail", f"found {p.detail['found'] - p.detail['expected']} further, changed {','.join(p.detail['changed'])}, contended {p.detail['contended']}"
    yield "recorded once", EditLog(store).history().count()
    stale = store.version("customer") - 1
    for what, write in (
        ("insert", lambda: store.insert_row("customer", {"c_custkey": 99}, stale)), ("replace", lambda: TableStore.replace_row(store, "customer", "c_custkey", 5, {"c_custkey": 5}, stale)),
        ("delete", lambda: store.delete_row("customer", "c_custkey", 5, stale)), ("create", lambda: store.create("customer", small.schema)),
    ):
        try:
            write()
            yield f"stale {what}", "written"
        except StrataError as e:
            yield f"stale {what}", type(e).__name__


verdicts("action_races", _races, {
    "retried on fresh values": "applied after 2, Rival, BUILDING", "the rival's change decides": "refused after 2, validation_failed", "three attempts": "failed after 3, conflict, retryable True",
    "conflict detail": "found 1 further, changed acctBal, contended False", "recorded once": 1,
    "stale insert": "ConflictError", "stale replace": "ConflictError", "stale delete": "ConflictError", "stale create": "ConflictError",
})


def _edits(spark: SparkSession, d: str) -> DataFrame:
    rt, store = _runtime(spark, d, log=True)
    for action, params, dry in (
        ("shout", {"customer": 7}, False), ("closeAccount", {"customer": 7}, True), ("closeAccount", {"customer": -7}, False), ("closeAccount", {"customer": -7}, True),
        ("closeAccount", {"customer": "seven"}, False), ("closeAccount", {"customer": 8}, False),
    ):
        rt.run(action, params, "ada", dry)
    notes = store.manifest("customer")["notes"]
    log = EditLog(store).history().withColumn("stamped", F.col("edit_id") == F.lit(notes["edit_id"]))
    return log.select("action", "operation", "object_type", "object_key", "status", "code", "actor", F.col("attempts").cast("int").alias("attempts"), "stamped", F.col("recorded_at").cast("string").alias("recorded"))


add(
    "edit_log_rows", _edits,
    "SELECT * FROM (VALUES ('shout', 'modify', 'Customer', '7', 'applied', NULL, 'ada', 1, false, '2026-01-04 12:00:00'), "
    "('closeAccount', 'delete', 'Customer', '-7', 'refused', 'object_not_found', 'ada', 1, false, '2026-01-04 12:00:00'), "
    "('closeAccount', 'delete', 'Customer', '8', 'applied', NULL, 'ada', 1, true, '2026-01-04 12:00:00')) t(action, operation, object_type, object_key, status, code, actor, attempts, stamped, recorded)",
)


# Filters, expressions, the specification


def _filters(spark: SparkSession, d: str) -> Rows:
    x = demo.ontology().objects["Customer"]
    for p in x.props.values():
        yield f"operators of {p.name}", ",".join(operators(x, p))
    schema = json_schema(x, frozenset({"acctBal"}))["properties"]
    yield "schema leaves out masked ones", ",".join(sorted(schema))
    yield "schema of a searchable string", ",".join(schema["name"]["anyOf"][1]["properties"])
    yield "schema of an enum", ",".join(schema["segment"]["anyOf"][0]["enum"])
    yield "order of conditions", len(conditions(x, {"acctBal": {"lte": 9, "ne": 1, "gt": 0}}))
    yield "first condition", "<=>" in str(conditions(x, {"acctBal": {"lte": 9, "ne": 1}})[0])
    for what, asked in (
        ("unknown property", {"nam": 1}), ("masked property", {"acctBal": 1}), ("bare null", {"name": None}), ("no operator", {"name": {}}), ("unknown operator", {"name": {"equals": 1}}),
        ("contains of a number", {"customerId": {"contains": "1"}}), ("order of an enum", {"segment": {"gt": "A"}}), ("null operand of an order", {"name": {"gt": None}}), ("not of the type", {"customerId": "x"}),
    ):
        yield what, tried(lambda a=asked: conditions(x, a, frozenset({"acctBal"})))
    r = demo.resolver(spark, d)
    yield "links of a customer", ",".join(sorted(r.hops("Customer")))
    yield "links of a part", ",".join(sorted(r.hops("Part")))
    yield "limit below 1", tried(lambda: r.list("Customer", 0))
    yield "offset below 0", tried(lambda: r.list("Customer", 1, -1))


verdicts("filter_verdicts", _filters, {
    "operators of customerId": "eq,ne,gt,gte,lt,lte", "operators of name": "eq,ne,gt,gte,lt,lte,contains", "operators of nationId": "eq,ne,gt,gte,lt,lte", "operators of acctBal": "eq,ne,gt,gte,lt,lte",
    "operators of segment": "eq,ne", "schema leaves out masked ones": "customerId,name,nationId,segment", "schema of a searchable string": "eq,ne,gt,gte,lt,lte,contains",
    "schema of an enum": "AUTOMOBILE,BUILDING,FURNITURE,HOUSEHOLD,MACHINERY", "order of conditions": 3, "first condition": "True",
    "unknown property": "refused: Customer has no property 'nam' (did you mean 'name'?); it has customerId, name, nationId, segment",
    "masked property": "refused: 'acctBal' is withheld here and can't be filtered on", "bare null": "refused: null} to ask for nulls", "no operator": "refused: no operator is given",
    "unknown operator": "refused: no operator 'equals'", "contains of a number": "refused: 'contains' doesn't apply; only searchable strings admit it",
    "order of an enum": "refused: 'gt' doesn't apply; enum has no order", "null operand of an order": "refused: 'gt' needs a value", "not of the type": "refused: 'x'",
    "links of a customer": "livesIn,neighbours,orders", "links of a part": "orderedIn,suppliedBy", "limit below 1": "refused: limit must be 1 or more", "offset below 0": "refused: offset must be 0 or more",
})


def _types(spark: SparkSession, d: str) -> Rows:
    o = demo.ontology()
    x = o.objects["Customer"]
    for text in (
        "1 + 2", "1 + 2.5", "7 / 2", "'a' + object.name", "object.segment + 'x'", "len(object.name)", "upper(object.name)", "now()", "coalesce(null, object.acctBal)", "object.nationId == 3 && true",
        "-object.acctBal", "!true", "object.segment == null", "1 + 'a'", "object.name < 3", "!1", "len(3)", "true < false", "object.nope", "nothing", "principal.sub", "coalesce(1, 'a')",
    ):
        try:
            yield text, infer(parse(text), o, {}, x).kind
        except Exception as e:
            yield text, type(e).__name__
    for name, (least, most) in FUNCTIONS.items():
        yield f"{name} takes", f"{least} to {'any' if most is None else most}"
    for text in ("now(1)", "len()", "lower('a', 'b')", "coalesce()", "sqrt(2)"):
        try:
            parse(text)
            yield text, "parsed"
        except StrataError:
            yield text, "refused"


verdicts("type_verdicts", _types, {
    "1 + 2": "long", "1 + 2.5": "double", "7 / 2": "double", "'a' + object.name": "string", "object.segment + 'x'": "string", "len(object.name)": "long", "upper(object.name)": "string", "now()": "timestamp",
    "coalesce(null, object.acctBal)": "double", "object.nationId == 3 && true": "boolean", "-object.acctBal": "double", "!true": "boolean", "object.segment == null": "boolean",
    "1 + 'a'": "TypeProblem", "object.name < 3": "TypeProblem", "!1": "TypeProblem", "len(3)": "TypeProblem", "true < false": "TypeProblem", "object.nope": "TypeProblem", "nothing": "TypeProblem",
    "principal.sub": "TypeProblem", "coalesce(1, 'a')": "TypeProblem", "now takes": "0 to 0", "lower takes": "1 to 1", "upper takes": "1 to 1", "len takes": "1 to 1", "coalesce takes": "1 to any",
    "now(1)": "refused", "len()": "refused", "lower('a', 'b')": "refused", "coalesce()": "refused", "sqrt(2)": "refused",
})


def _documents() -> list[dict]:
    return yaml.safe_load(demo.SPEC)


def _changed(path: list, value: Any) -> list[dict]:
    docs = _documents()
    at = docs
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return docs


def _spec(spark: SparkSession, d: str) -> Rows:
    at = {name: i for i, doc in enumerate(_documents()) for body in doc.values() for name in [body["apiName"]]}
    c, link, act = [at["Customer"], "objectType"], [at["placedBy"], "linkType"], [at["moveSegment"], "action"]
    with tempfile.TemporaryDirectory() as folder:
        for i, doc in enumerate(_documents()):
            (Path(folder) / f"{i}.yaml").write_text(yaml.safe_dump(doc))
        from .spec import build

        o, report = build(folder)
        yield "loaded", f"{len(o.objects)} kinds, {len(o.links)} links, {len(o.actions)} actions"
        yield "warnings", ",".join(sorted({w.partition(':')[0] for w in report.warnings}))
    for what, path, value in (
        ("key that is no property", [*c, "primaryKey"], "id"), ("nullable key", [*c, "properties", 0, "nullable"], True), ("key not unique", [*c, "properties", 0, "unique"], False),
        ("column twice", [*c, "properties", 1, "column"], "c_custkey"), ("property twice", [*c, "properties", 1, "name"], "customerId"), ("unknown type", [*c, "properties", 1, "type"], "strin"),
        ("enum without values", [*c, "properties", 4, "values"], []), ("unknown key", [*c, "colour"], 1), ("missing key", [*c, "title"], KeyError), ("renamed to itself", [*c, "properties", 1, "renamedFrom"], "c_name"),
        ("kinds that don't compare", [*link, "to", "property"], "name"), ("mapping where none goes", [*link, "cardinality"], "many_to_many"), ("end of no kind", [*link, "to", "objectType"], "Custmer"),
        ("rule that is no condition", [*act, "validation", 0, "rule"], "segment"), ("rule that reads the caller", [*act, "validation", 0, "rule"], "principal.sub == 'x'"),
        ("key that is set", [*act, "effects", 0, "modifyObject", "set"], {"customerId": "customer"}), ("another operation", [*act, "operation"], "delete"), ("target of no kind", [*act, "targetObjectType"], "X"),
        ("needed property not set", [at["openAccount"], "action", "effects", 0, "createObject", "set"], {"customerId": "id"}),
    ):
        yield what, tried(lambda p=path, v=value: from_documents(_changed(p, v)))


verdicts("spec_verdicts", _spec, {
    "loaded": "9 kinds, 8 links, 5 actions", "warnings": "neighbours", "key that is no property": "refused: 'id'", "nullable key": "refused: the primary key can't be nullable",
    "key not unique": "refused: the primary key must be declared unique", "column twice": "refused: column 'c_custkey' is declared twice", "property twice": "refused: a property of this name is declared twice",
    "unknown type": "refused: 'type' must be one of string, boolean, int, long, double, decimal, date, timestamp, enum, objectRef (did you mean 'string'?)", "enum without values": "refused: an enum needs 'values', each once",
    "unknown key": "refused: unknown key 'colour'", "missing key": "refused: 'title' is missing", "renamed to itself": "refused: 'renamedFrom' is the column's present name",
    "kinds that don't compare": "refused: long and string can't be joined", "mapping where none goes": "refused: 'through' is for many_to_many links, and for these it is needed",
    "end of no kind": "refused: no object type 'Custmer' (did you mean 'Customer'?)", "rule that is no condition": "refused: expected boolean, found enum",
    "rule that reads the caller": "refused: the caller can't be read in a specification", "key that is set": "refused: the primary key can't be modified",
    "another operation": "refused: a delete action needs exactly one deleteObject effect", "target of no kind": "refused: no object type 'X'", "needed property not set": "refused: doesn't set 'nationId', which can't be null",
})


# Governance


def _policies(spark: SparkSession, d: str) -> Rows:
    o, kinds = demo.ontology(), {"dept": "string", "groups": "string[]", "rank": "int"}
    say = lambda **p: tried(lambda: len(bind([{"name": "p", "objectType": "Customer", **p}], o, kinds).policies))
    yield "mask of the key", say(mask=["customerId"])
    yield "mask of a joined property", say(mask=["nationId"])
    yield "mask of what an action touches", say(mask=["segment"])
    yield "mask of nothing", say(mask=["nope"])
    yield "a mask that holds", say(mask=["acctBal"])
    yield "withholds nothing", say()
    yield "mask with a guard", say(mask=["name"], when="true")
    yield "guard that reads a row", say(rows="object.nationId > 1", when="object.nationId > 1")
    yield "undeclared claim", say(rows="object.name == principal.team")
    yield "list against a property", say(rows="object.name == principal.groups")
    yield "function in a row policy", say(rows="len(object.name) > 1")
    yield "order with null", say(rows="object.nationId < null")
    yield "not of the enum", say(rows="object.segment == 'GARDEN'")
    yield "reads no property", say(rows="1 == 1")
    yield "unknown kind of object", tried(lambda: bind([{"name": "p", "objectType": "Custmer", "mask": ["x"]}], o))
    guarded = bind([{"name": "p", "objectType": "Customer", "rows": "object.nationId > 1", "when": "principal.groups contains 'desk'"}], o, kinds)
    yield "no caller", tried(lambda: guarded.select(None))
    yield "undecided set", tried(lambda: replace(guarded.select(Principal.of({"sub": "u"}, kinds)), decided=False).masked("Customer"))
    caller = Principal.of({"sub": "u", "dept": 5, "groups": ["a", 1], "rank": True, "iss": "i", "other": 1}, kinds)
    yield "readable claims", ",".join(sorted(caller.claims))
    yield "claims of their kinds", ",".join(sorted(Principal.of({"sub": "u", "dept": "x", "groups": ["a"], "rank": 3}, kinds).claims))
    plain = config.parse({"catalogs": {"star": {"type": "parquet", "path": d}}, "governance": {"edit_log": "required"}})
    yield "required log without a store", tried(lambda: plain.logs(o, plain.open(spark)))
    store = TableStore(spark, tempfile.mkdtemp(prefix="log-", dir=_folder(spark)))
    deployed = config.parse({"catalogs": {"star": {"type": "store", "path": str(store.root)}}, "governance": {"edit_log": "required"}})
    yield "required log", ",".join(deployed.logs(o, {"star": store}))
    yield "log exists", store.exists("strataview_meta.edits")
    bare = TableStore(spark, tempfile.mkdtemp(prefix="log-", dir=_folder(spark)))
    bare.create("strataview_meta.edits", StructType([StructField("edit_id", StringType())]))
    yield "log without a principal column", tried(lambda: EditLog(bare, attested=True))


verdicts("policy_verdicts", _policies, {
    "mask of the key": "refused: it is the primary key", "mask of a joined property": "refused: link 'livesIn' joins on it", "mask of what an action touches": "refused: action 'moveSegment' touches it",
    "mask of nothing": "refused: Customer has no such property", "a mask that holds": 1, "withholds nothing": "refused: it withholds nothing",
    "mask with a guard": "refused: 'when' goes with 'rows' alone", "guard that reads a row": "refused: a guard reads the caller only, not 'object.nationId'", "undeclared claim": "refused: no claim 'team' is declared",
    "list against a property": "refused: a list can't be compared with a property", "function in a row policy": "refused: a row policy compares properties, literals and claims; it can't use call 'len'",
    "order with null": "refused: int and null have no order", "not of the enum": "refused: the enum has no value 'GARDEN'", "reads no property": "refused: the row policy reads no property",
    "unknown kind of object": "refused: no object type 'Custmer' (did you mean 'Customer'?)", "no caller": "refused: these policies depend on the caller, and there is none",
    "undecided set": "refused: the policies aren't decided for a caller", "readable claims": "iss,sub", "claims of their kinds": "dept,groups,rank,sub",
    "required log without a store": "refused: edit_log is required, and catalog 'star' can't hold one", "required log": "star", "log exists": "True",
    "log without a principal column": "refused: the edit log has no column for the principal",
})


# Tables and migrations


def _tables(spark: SparkSession, d: str) -> Rows:
    store = _stored(spark, d, "nation", ParquetCatalog(spark, d).table("nation").select("n_nationkey", "n_name"))
    yield "exists", f"{store.exists('nation')} {store.exists('nations')} {ParquetCatalog(spark, d).exists('nation')} {ParquetCatalog(spark, d).exists('nations')}"
    yield "columns", ",".join(store.schema("nation").names)
    yield "version", store.version("nation")
    store.insert_row("nation", {"n_nationkey": None, "n_name": "NOWHERE"}, 2)
    yield "after an insert", store.version("nation")
    store.delete_row("nation", "n_nationkey", None, 3)
    yield "null key filter", store.table("nation").count()
    yield "an older version", store.table("nation", 3).count()
    yield "null in a scan", ParquetCatalog(spark, d).scan("nation", None, [("n_name", None)]).count()
    yield "overwritten", f"{store.overwrite('nation', store.table('nation').limit(3))} {store.table('nation').count()}"
    odd = spark.range(3).select(F.col("id").alias("a.b`c"), F.col("id").alias("select"))
    docs = [{"objectType": {"apiName": "Odd", "primaryKey": "k", "title": "k", "backing": {"catalog": "star", "table": "odd"}, "properties": [
        {"name": "k", "type": "long", "column": "a.b`c", "unique": True}, {"name": "v.w", "type": "long", "column": "select"}]}}]
    r = Resolver(from_documents(docs), {"star": ViewCatalog({"odd": odd})})
    yield "odd column names", str([tuple(x) for x in r.search("Odd", {"v.w": {"gt": 0}}).collect()])
    yield "odd key", r.get("Odd", 2)
    live: Catalog = ParquetCatalog(spark, d)
    report = Report()
    validate_physical(demo.ontology(), {"star": live}, report)
    yield "keys that may hold nulls", len([e for e in report.errors if e.endswith("may not")])
    yield "a column of another type", next(e for e in report.errors if "declared" in e)
    report = Report()
    validate_physical(from_documents(_changed([2, "objectType", "properties", 1, "column"], "c_nam")), {"star": live}, report)
    yield "a column that isn't there", next(e for e in report.errors if "no column" in e)


verdicts("table_verdicts", _tables, {
    "exists": "True False True False", "columns": "n_nationkey,n_name", "version": 2, "after an insert": 3, "null key filter": 25, "an older version": 26, "null in a scan": 0, "overwritten": "5 3",
    "odd column names": "[(1, 1), (2, 2)]", "odd key": "{'k': 2, 'v.w': 2}", "keys that may hold nulls": 9, "a column of another type": "Order: column 'o_orderdate' is timestamp_ntz, declared date",
    "a column that isn't there": "Customer: customer has no column 'c_nam' (did you mean 'c_name'?)",
})


def _ports(*columns: tuple) -> dict[str, str]:
    props = [{"name": "id", "type": "long", "column": "id", "unique": True}, *({"name": n, "type": t, "column": c, "nullable": True, **({"renamedFrom": w} if w else {})} for n, t, c, w in columns)]
    return {"port.yaml": yaml.safe_dump({"objectType": {"apiName": "Port", "primaryKey": "id", "title": "id", "backing": {"catalog": "main", "table": "ports"}, "properties": props}})}


def _migrations(spark: SparkSession, d: str) -> Rows:
    store = TableStore(spark, tempfile.mkdtemp(prefix="ports-", dir=_folder(spark)))
    stores = {"main": store}
    said = lambda a: f"{a.status} {a.version} {','.join(c.op for c in a.plan.changes)}".strip()
    one = _ports(("size", "int", "size", None))
    yield "create", said(apply(one, stores, now=NOW))
    yield "again", said(apply(one, stores, now=NOW))
    store.append_rows("ports", [{"id": 1, "size": 7}])
    files = store.manifest("ports")["files"]
    two = _ports(("tons", "long", "tons", "size"), ("note", "string", "note", None))
    p = plan(from_documents([yaml.safe_load(two["port.yaml"])]), stores)
    yield "rendered", p.render().replace("\n", " | ")
    yield "rename, promote, add", said(apply(two, stores, now=NOW))
    yield "row kept", store.table("ports").first().asDict()
    yield "files kept", store.manifest("ports")["files"] == files
    yield "refused whole", said(apply(_ports(("tons", "boolean", "tons", None), ("more", "string", "more", None)), stores, now=NOW))
    done, left = rollback(1, stores, now=NOW)
    yield "rolled back", f"{done.status} {done.version} {done.error or ''}".strip()
    yield "left behind", ",".join(left)
    rows = History(stores).rows()
    yield "history", ",".join(f"{r['version']} {r['status']}" for r in rows)
    yield "unknown version", tried(lambda: rollback(9, stores))
    clash = _ports(("a", "long", "tons", "note"))
    yield "rename onto a live column", tried(lambda: ",".join(c.severity for c in plan(from_documents([yaml.safe_load(clash["port.yaml"])]), stores).changes))
    twice = _ports(("a", "long", "a", "x"), ("b", "long", "b", "x"))
    yield "renamed twice", tried(lambda: from_documents([yaml.safe_load(twice["port.yaml"])]))
    store.alter("ports", loosen=["id"], add=[StructField("extra", LongType())])
    p = plan(from_documents([yaml.safe_load(one["port.yaml"])]), stores)
    yield "unmanaged columns", ",".join(p.unmanaged["ports"])


verdicts("migration_verdicts", _migrations, {
    "create": "applied 1 create", "again": "up-to-date 1",
    "rendered": "main: ports |   [physical-safe] rename 'size' to 'tons' |   [physical-safe] 'tons' from int to long |   [safe] add 'note' string",
    "rename, promote, add": "applied 2 rename,promote,add", "row kept": "{'id': 1, 'tons': 7, 'note': None}", "files kept": "True", "refused whole": "refused None retype,add",
    "rolled back": "refused None the plan has breaking changes", "left behind": "ports.note", "history": "1 applied,2 applied", "unknown version": "refused: version 9 was never applied",
    "rename onto a live column": "breaking", "renamed twice": "refused: column 'x' is renamed twice", "unmanaged columns": "tons,note,extra",
})


# Roll-up with its provenance


def _refreshed(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d, "orders", ParquetCatalog(spark, d).table("orders"))
    args = (store, "orders", "daily", NOW, "o_orderdate", "o_totalprice", "o_custkey")
    rollup.refresh(*args)
    rollup.refresh(*args)  # the whole table anew
    t = store.table("daily")
    return t.withColumns({"gross_sales": F.col("gross_sales").cast("double"), "sales_date": F.col("sales_date").cast("string"), "refreshed_at": F.col("refreshed_at").cast("string")})


add(
    "rollup_refreshed", _refreshed,
    "SELECT o_orderdate::DATE::VARCHAR AS sales_date, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(14,2)::DOUBLE AS gross_sales, count(*) AS order_count, count(DISTINCT o_custkey) AS unique_customers, "
    "'2026-01-04 12:00:00' AS refreshed_at, 'orders' AS source_table, 2::BIGINT AS source_snapshot_id FROM orders GROUP BY o_orderdate::DATE",
)


# Tools and surfaces


def _served(spark: SparkSession, d: str) -> Rows:
    o = demo.ontology()
    r = demo.resolver(spark, d, [{"name": "m", "objectType": "Supplier", "mask": ["acctBal"]}])
    rt, _ = _runtime(spark, d)
    read, every = tools(o, r), tools(o, r, rt)
    yield "tools", f"{len(read)} to read, {len(every) - len(read)} to run"
    yield "tools of a customer", ",".join(sorted(t for t in every if "customer" in t))
    yield "needed arguments", ",".join(every["traverse_customer"].schema["required"]) + ";" + ",".join(every["run_move_segment"].schema["required"])
    yield "snake case", ",".join(map(snake_case, ("DailySales", "HTTPPort", "x9Y")))
    page = json.loads(call(read, "list_supplier", {"limit": 2})[0])
    yield "page", f"{page['count']} {page['hasMore']} {page['masked']} {sorted(page['objects'][0])}"
    last = json.loads(call(read, "list_region", {"limit": 10})[0])
    yield "last page", f"{last['count']} {last['hasMore']}"
    for what, name, args in (
        ("unknown tool", "get_custmer", {}), ("missing argument", "get_customer", {}), ("unknown argument", "get_customer", {"key": 1, "keys": 2}), ("refused filter", "search_customer", {"filters": {"nam": 1}}),
    ):
        text, bad = call(every, name, args)
        yield what, f"{bad} {text}"
    ran = json.loads(call(every, "run_shout", {"customer": 5, "dryRun": True})[0])
    yield "dry run", ran["status"]
    asked = lambda **m: answer("demo", read, {"jsonrpc": "2.0", "id": 1, **m})
    yield "handshake", asked(method="initialize", params={"protocolVersion": "2025-03-26"})["result"]["protocolVersion"]
    yield "listed", len(asked(method="tools/list")["result"]["tools"])
    yield "called", json.loads(asked(method="tools/call", params={"name": "get_region", "arguments": {"key": 1}})["result"]["content"][0]["text"])["object"]["name"]
    yield "unknown method", asked(method="prompts/list")["error"]["code"]
    yield "notification", answer("demo", read, {"jsonrpc": "2.0", "method": "notifications/initialized"})
    yield "needs of an engine", ",".join(sorted(negotiate.requirements(o)))
    yield "unmet needs", ",".join(negotiate.unmet(o, negotiate.Capabilities("weak", joins=False)))
    yield "an engine that lacks joins", tried(lambda: negotiate.check(o, negotiate.Capabilities("weak", joins=False)))
    yield "Spark", negotiate.unmet(o)
    some = {"a": {"type": "spark"}}
    for what, raw in (
        ("no catalogs", {}), ("unknown catalog type", {"catalogs": {"a": {"type": "parqet"}}}), ("unknown section", {"catalogs": some, "enigne": {}}), ("another engine", {"catalogs": some, "engine": {"type": "x"}}),
        ("open writes", {"catalogs": some, "mcp": {"transport": "http", "host": "0.0.0.0", "allow_writes": True}}), ("tokens over streams", {"catalogs": some, "mcp": {"auth": {"issuer": "i", "audience": "a", "jwks_uri": "/k"}}}),
    ):
        yield what, tried(lambda raw=raw: config.parse(raw))
    with tempfile.TemporaryDirectory() as folder:
        spec = Path(folder) / "spec"
        spec.mkdir()
        for i, doc in enumerate(_documents()):
            (spec / f"{i}.yaml").write_text(yaml.safe_dump(doc))
        cfg = Path(folder) / "strataview.yaml"
        cfg.write_text(yaml.safe_dump({"catalogs": {"star": {"type": "parquet", "path": d}}}))
        for args in (("validate",), ("query", "Region", "--key", "1"), ("query", "Region", "--filter", "name=A", "--limit", "2"), ("query", "Region", "--key", "99"), ("query", "Regio"), ("query", "Nation", "--key", "3", "--link", "inRegion")):
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                code = cli.main([args[0], str(spec), "--config", str(cfg), *args[1:]], spark)
            lines = [x for x in out.getvalue().splitlines() if not x.startswith("warning")]
            yield " ".join(args), f"{code} {lines[0] if code or args == ('validate',) else len(lines)}"


#: The signed token and the key of RFC 7515, appendix A.3.
RFC_TOKEN = (
    "eyJhbGciOiJFUzI1NiJ9.eyJpc3MiOiJqb2UiLA0KICJleHAiOjEzMDA4MTkzODAsDQogImh0dHA6Ly9leGFtcGxlLmNvbS9pc19yb290Ijp0cnVlfQ."
    "DtEhU3ljbEg8L38VWAfUAqOyKAM6-Xx-F4GawxaepmXFCgfTjDxw5djxLa8ISlSApmWQxfKTUJqPP3-Kg6NU1Q"
)
RFC_KEY = {"kty": "EC", "crv": "P-256", "x": "f83OJ3D2xF1Bg8vub9tLe1gHMzV76e8Tus9uPHvRVEU", "y": "x_FEzRu9m36HLN_tue659LNpXW6pCyStikYjKIWI5a0"}


def _tokens(spark: SparkSession, d: str) -> Rows:
    held = auth.KeySet("unused")
    held.fetch = lambda: {"keys": [RFC_KEY]}  # type: ignore[method-assign]
    v = auth.Verifier("joe", "port", held, clock=lambda: 1300819000.0)
    head, body, mark = RFC_TOKEN.split(".")
    yield "a signature that holds", tried(lambda: v.verify(RFC_TOKEN))  # it lacks an audience and a name
    yield "another body", tried(lambda: v.verify(f"{head}.{body.replace('qb2Ui', 'qb2Yi')}.{mark}"))
    yield "cut signature", tried(lambda: v.verify(f"{head}.{body}.{mark[:40]}"))
    for alg in ("none", "HS256"):
        made = auth.base64.urlsafe_b64encode(json.dumps({"alg": alg}).encode()).decode().rstrip("=")
        yield alg, tried(lambda m=made: v.verify(f"{m}.{body}.{mark}"))
    yield "no token", tried(lambda: v.verify("abc"))
    good = {"iss": "joe", "aud": "port", "exp": 1300819380, "sub": "ada"}
    for what, change in (("all claims", {}), ("expired", {"exp": 1300818999}), ("for another", {"aud": "x"}), ("from another", {"iss": "x"}), ("not yet", {"nbf": 1300819100}), ("of nobody", {"sub": ""})):
        yield what, tried(lambda c=change: v._named({**good, **c}).claims["sub"])


verdicts("token_verdicts", _tokens, {
    "a signature that holds": "refused: a token needs iss, aud, exp, sub", "another body": "refused: the signature doesn't hold", "cut signature": "refused: the signature doesn't hold",
    "none": "refused: tokens signed with 'none' aren't accepted", "HS256": "refused: tokens signed with 'HS256' aren't accepted", "no token": "refused: not a signed token", "all claims": "ada",
    "expired": "refused: it has expired", "for another": "refused: it is from or for someone else", "from another": "refused: it is from or for someone else", "not yet": "refused: it isn't valid yet",
    "of nobody": "refused: it names nobody",
})

verdicts("surface_verdicts", _served, {
    "tools": "35 to read, 5 to run", "tools of a customer": "get_customer,list_customer,search_customer,traverse_customer", "needed arguments": "key,link;customer,segment", "snake case": "daily_sales,http_port,x9_y",
    "page": "2 True ['acctBal'] ['name', 'nationId', 'supplierId']", "last page": "5 False", "unknown tool": "True no tool 'get_custmer' (did you mean 'get_customer'?)",
    "missing argument": "True argument 'key' is missing", "unknown argument": "True unknown argument 'keys' (did you mean 'key'?)",
    "refused filter": "True Customer has no property 'nam' (did you mean 'name'?); it has customerId, name, nationId, acctBal, segment", "dry run": "previewed", "handshake": "2025-03-26", "listed": 35, "called": "AMERICA",
    "unknown method": -32601, "notification": None, "needs of an engine": "case_insensitive_like,joins,offset", "unmet needs": "weak lacks 'joins', which link placedBy needs",
    "an engine that lacks joins": "refused: weak lacks 'joins', which link placedBy needs", "Spark": "[]", "no catalogs": "refused: no catalogs are declared",
    "unknown catalog type": "refused: type must be one of parquet, store, spark (did you mean 'parquet'?)", "unknown section": "refused: unknown key 'enigne' (did you mean 'engine'?)", "another engine": "refused: the type is spark",
    "open writes": "refused: writes over http need authentication, or a loopback host", "tokens over streams": "refused: standard streams carry no token; auth goes with transport http",
    "validate": "0 9 object types, 8 links, 5 actions", "query Region --key 1": "0 1", "query Region --filter name=A --limit 2": "0 2", "query Region --key 99": "1 not found",
    "query Regio": "1 error: no object type 'Regio' (did you mean 'Region'?)", "query Nation --key 3 --link inRegion": "0 1",
})
