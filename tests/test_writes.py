"""Versioned tables, actions under races, migrations, tools and the command line."""

import json
from dataclasses import replace
from io import StringIO

import pytest
import yaml
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from strataview.actions.log import TABLE as LOG
from strataview.actions.log import EditLog
from strataview.actions.runtime import Runtime
from strataview.errors import ConflictError, PolicyError, QueryError, Report, SpecErrors, StrataError
from strataview.migrate import apply, plan, rollback
from strataview.migrate.history import History, read_spec
from strataview.operators.governance import bind
from strataview.plans.resolver import Resolver
from strataview.sources.store import TableStore
from strataview.surface import cli, config, negotiate
from strataview.surface.server import serve_stdio
from strataview.surface.tools import call, json_safe, snake_case, tools
from strataview.validate import validate_physical

from . import harbour


@pytest.fixture
def store(spark, tmp_path):
    return harbour.store(spark, tmp_path / "tables")


def runtime(store, policies=(), log=None, **kw):
    o = harbour.ontology()
    return Runtime(o, {"main": store}, bind(list(policies), o).select(), {"main": log} if log else {}, clock=lambda: harbour.day(20), **kw)


def row(store, key):
    found = store.table("port.vessels").where(f"imo = '{key}'").collect()
    return found[0].asDict() if found else None


def test_snapshots_and_conflicts(store):
    v = store.version("port.vessels")
    store.insert_row("port.vessels", {"imo": "v8"}, v)
    assert store.table("port.vessels", v).count() == 7 and store.table("port.vessels").count() == 8
    for write in (
        lambda: store.insert_row("port.vessels", {"imo": "v9"}, v),
        lambda: store.replace_row("port.vessels", "imo", "v1", {"imo": "v1"}, v),
        lambda: store.delete_row("port.vessels", "imo", "v1", v),
        lambda: store.create("port.vessels", harbour.VESSELS),
    ):
        with pytest.raises(ConflictError):
            write()
    assert store.table("port.vessels").count() == 8 and not store.exists("nothing") and store.version("nothing") is None


def test_second_linker_loses(store):
    v, m = store.version("port.vessels"), store.manifest("port.vessels")
    schema = store.schema("port.vessels")
    store.commit("port.vessels", m["files"], schema, v)
    store.version = lambda name: v  # the other writer's view, before the first one's commit
    with pytest.raises(ConflictError):
        TableStore.commit(store, "port.vessels", m["files"], schema, v)


def test_required_columns_are_checked(store):
    with pytest.raises(Exception, match="can't be null"):
        store.append_rows("port.vessels", [{"call_name": "x"}])


def test_modify_carries_unmapped_columns(store):
    r = runtime(store).run("setState", {"vessel": "v2", "next": "sailing"}, actor="me")
    assert r.status == "applied" and r.before["state"] == "loading" and r.after["state"] == "sailing"
    assert row(store, "v2")["flag"] == "lv" and row(store, "v1")["berths"] == ["north 1", "north 2"]
    assert store.manifest("port.vessels")["notes"] == {"edit_id": r.edit_id, "action": "setState", "actor": "me"}


def test_create_delete(store):
    rt = runtime(store)
    args = {"nr": "t9", "vessel": "v1", "fare": "12.50"}
    assert rt.run("depart", args).status == "applied"
    assert str(store.table("port.voyages").where("nr = 't9'").first().fare_eur) == "12.50"
    assert rt.run("depart", args).problems[0].code == "object_exists"
    assert rt.run("scrap", {"vessel": "v4"}).status == "applied" and row(store, "v4") is None
    assert rt.run("scrap", {"vessel": "v4"}).problems[0].code == "object_not_found"


@pytest.mark.parametrize("action, args, codes", [
    ("setState", {"vessel": "v1", "next": "sailing"}, ["validation_failed"]), ("setState", {"vessel": "v1", "next": "tin", "x": 1}, ["unknown_parameter", "type_error"]),
    ("setState", {}, ["missing_parameter", "missing_parameter"]), ("refit", {"vessel": "v5"}, ["expression_error", "expression_error"]),
    ("depart", {"nr": "t8", "vessel": "v1", "fare": 1.5}, ["type_error"]), ("setState", {"vessel": "v9", "next": "sailing"}, ["object_not_found"]),
])
def test_refusals(store, action, args, codes):
    before = store.version("port.vessels"), store.version("port.voyages")
    r = runtime(store).run(action, args)
    assert r.status == "refused" and [p.code for p in r.problems] == codes
    assert before == (store.version("port.vessels"), store.version("port.voyages"))


def test_dry_run_and_unknown_action(store):
    log = EditLog(store)
    r = runtime(store, log=log).run("setState", {"vessel": "v2", "next": "sailing"}, dry_run=True)
    assert r.status == "previewed" and r.after["state"] == "sailing" and row(store, "v2")["state"] == "loading" and not store.exists(LOG)
    with pytest.raises(QueryError, match="did you mean"):
        runtime(store).run("setStat", {})


def test_ambiguous_key(store, spark):
    store.append("port.vessels", spark.createDataFrame(harbour.FLEET[:1], harbour.VESSELS))
    assert runtime(store).run("scrap", {"vessel": "v1"}).problems[0].code == "ambiguous_key"


def test_withheld_rows_can_not_be_written(store):
    p = [{"name": "r", "objectType": "Vessel", "rows": "object.tonnage > 10"}]
    rt = runtime(store, p)
    assert rt.run("scrap", {"vessel": "v3"}).problems[0].code == "object_not_found"
    assert rt.run("scrap", {"vessel": "v6"}).status == "applied"


class Interloper(TableStore):
    """Changes the table once before each of the first ``times`` commits of a row."""

    times, change = 0, {"call_name": "Else"}

    def replace_row(self, name, key, value, row, expect, notes=None):
        if self.times:
            self.times -= 1
            current = self.table(name).where(f"imo = '{value}'").first().asDict()
            super().replace_row(name, key, value, {**current, **self.change}, self.version(name))
        return super().replace_row(name, key, value, row, expect, notes)


def test_race_is_retried_on_fresh_values(store, spark):
    s = Interloper(spark, store.root)
    s.times = 1
    r = runtime(s).run("setState", {"vessel": "v2", "next": "sailing"})
    assert r.status == "applied" and r.attempts == 2 and row(s, "v2")["call_name"] == "Else" and row(s, "v2")["state"] == "sailing"


def test_race_that_changes_the_answer(store, spark):
    s = Interloper(spark, store.root)
    s.times, s.change = 1, {"state": "sailing"}
    r = runtime(s).run("setState", {"vessel": "v2", "next": "sailing"})
    assert r.status == "refused" and r.problems[0].code == "validation_failed" and r.attempts == 2


def test_three_strikes(store, spark):
    s = Interloper(spark, store.root)
    s.times = 9
    log = EditLog(s)
    r = runtime(s, log=log).run("setState", {"vessel": "v2", "next": "sailing"})
    assert r.status == "failed" and r.problems[0].code == "conflict" and r.problems[0].retryable and r.attempts == 3 and row(s, "v2")["state"] == "loading"
    assert log.history().count() == 1


def test_edit_log(store):
    log = EditLog(store)
    rt = runtime(store, log=log)
    rt.run("setState", {"vessel": "v2", "next": "sailing"}, actor="me")
    rt.run("setState", {"vessel": "v2", "next": "sailing"})
    rt.run("setState", {"next": "sailing"})  # no key: not recorded
    got = sorted((r.status, r.code or "", r.object_key) for r in log.history().collect())
    assert got == [("applied", "", "v2"), ("refused", "validation_failed", "v2")]


def test_lost_record_does_not_hide_the_commit(store):
    class Broken(EditLog):
        def record(self, **row):
            raise OSError("full")

    r = runtime(store, log=Broken(store)).run("setState", {"vessel": "v2", "next": "sailing"})
    assert r.status == "applied" and [p.code for p in r.problems] == ["log_failed"]


def write_spec(root, docs):
    root.mkdir(exist_ok=True)
    for i, d in enumerate(docs):
        (root / f"{i}.yaml").write_text(yaml.safe_dump(d))
    return root


def widgets(*props):
    return [{"objectType": {
        "apiName": "Widget", "primaryKey": "id", "title": "id", "backing": {"catalog": "main", "table": "demo.widgets"},
        "properties": [{"name": "id", "type": "string", "column": "id", "unique": True}, *props],
    }}]


def prop(name, kind="double", **kw):
    return {"name": name, "type": kind, "column": kw.pop("column", name), "nullable": True, **kw}


@pytest.fixture
def empty(spark, tmp_path):
    return TableStore(spark, tmp_path / "w")


def test_migration_life(empty, tmp_path):
    root = write_spec(tmp_path / "spec", widgets(prop("old_score")))
    stores = {"main": empty}
    first = apply(read_spec(root), stores)
    assert first.status == "applied" and first.version == 1 and apply(read_spec(root), stores).status == "up-to-date"
    empty.append_rows("demo.widgets", [{"id": "a", "old_score": 1.5}])
    files = empty.manifest("demo.widgets")["files"]
    write_spec(root, widgets(prop("score", renamedFrom="old_score"), prop("note", "string")))
    second = apply(read_spec(root), stores)
    assert second.status == "applied" and [c.op for c in second.plan.changes] == ["rename", "add"]
    assert empty.table("demo.widgets").first().asDict() == {"id": "a", "score": 1.5, "note": None} and empty.manifest("demo.widgets")["files"] == files
    done, left = rollback(1, stores, root)
    assert done.status == "applied" and done.version == 3 and left == ["demo.widgets.note"]
    assert empty.table("demo.widgets").first().old_score == 1.5 and "old_score" in (root / "0.yaml").read_text()
    assert [r["version"] for r in History(stores).rows()] == [1, 2, 3]
    with pytest.raises(QueryError):
        rollback(9, stores)


def test_promotions_keep_rows(empty):
    empty.create("t", StructType([StructField("a", IntegerType()), StructField("b", LongType()), StructField("c", IntegerType(), False)]))
    empty.append_rows("t", [{"a": 1, "b": 2, "c": 3}])
    empty.alter("t", promote={"a": LongType(), "b": DoubleType(), "c": DoubleType()}, loosen=["c"])
    assert empty.table("t").first().asDict() == {"a": 1, "b": 2.0, "c": 3.0}
    empty.append_rows("t", [{"a": 1 << 40, "b": 0.5, "c": None}])
    assert empty.table("t").count() == 2


@pytest.mark.parametrize("props, ops, severity", [
    ([prop("score", "string")], ["retype"], "breaking"), ([prop("score", "double", nullable=False)], ["tighten"], "breaking"), ([prop("n", "int", nullable=False)], ["add"], "breaking"),
    ([prop("score"), prop("x", renamedFrom="nothing")], ["add"], "safe"), ([prop("s2", column="id2", renamedFrom="score")], ["rename"], "physical-safe"),
])
def test_severity(empty, props, ops, severity):
    empty.create("demo.widgets", StructType([StructField("id", StringType(), False), StructField("score", DoubleType())]))
    from strataview.spec import from_documents

    p = plan(from_documents(widgets(*props)), {"main": empty})
    assert [c.op for c in p.changes] == ops and {c.severity for c in p.changes} == {severity} and p.render()


def test_breaking_plans_are_refused_whole(empty, tmp_path):
    empty.create("demo.widgets", StructType([StructField("id", StringType(), False), StructField("score", StringType())]))
    got = apply(read_spec(write_spec(tmp_path / "spec", widgets(prop("score"), prop("more")))), {"main": empty})
    assert got.status == "refused" and empty.version("demo.widgets") == 1


def test_rename_onto_a_live_column_is_breaking(empty):
    from strataview.spec import from_documents

    empty.create("demo.widgets", StructType([StructField("id", StringType(), False), StructField("a", DoubleType()), StructField("b", DoubleType())]))
    p = plan(from_documents(widgets(prop("b", renamedFrom="a"))), {"main": empty})
    assert [c.severity for c in p.changes] == ["breaking"]


def test_shared_tables_merge(empty):
    from strataview.migrate import desired
    from strataview.spec import from_documents

    a, b = widgets(prop("score"))[0], widgets(prop("score", nullable=False))[0]
    b["objectType"]["apiName"] = "Other"
    assert desired(from_documents([a, b]))["main", "demo.widgets"]["score"].nullable
    b["objectType"]["properties"][1]["type"] = "long"
    with pytest.raises(SpecErrors, match="declared both"):
        desired(from_documents([a, b]))


def test_physical_validation(store):
    r = Report()
    validate_physical(harbour.ontology(), {"main": store}, r)
    assert r.errors == []
    o = harbour.ontology()
    x = o.objects["Vessel"]
    o.objects["Vessel"] = replace(x, props={**x.props, "tonnage": replace(x.props["tonnage"], column="gros_tons")})
    validate_physical(o, {"main": store}, r)
    assert any("did you mean 'gross_tons'" in e for e in r.errors)


def test_tools(store):
    o = harbour.ontology()
    t = tools(o, Resolver(o, {"main": store}), runtime(store))
    assert {"get_vessel", "search_voyage", "list_vessel", "traverse_vessel", "run_set_state"} <= set(t)
    got, bad = call(t, "list_vessel", {"limit": 2})
    page = json.loads(got)
    assert not bad and page["count"] == 2 and page["hasMore"] and page["masked"] == []
    order = json.loads(call(t, "get_voyage", {"key": "t1"})[0])["object"]
    assert order["fare"] == "820.40" and order["leftAt"].startswith("2026-01-04T12:00")
    for name, args in (("get_vessel", {}), ("get_vessel", {"key": "v1", "x": 1}), ("get_vesel", {}), ("search_vessel", {"filters": {"nope": 1}})):
        assert call(t, name, args)[1]
    ran = json.loads(call(t, "run_set_state", {"vessel": "v2", "next": "sailing", "dryRun": True})[0])
    assert ran["status"] == "previewed"
    assert not any(n.startswith("run_") for n in tools(o, Resolver(o, {"main": store})))
    assert snake_case("DailySalesPerformance") == "daily_sales_performance" and json_safe({"b": b"\x01"}) == {"b": "01"}


def test_serving(store):
    o, out = harbour.ontology(), StringIO()
    asked = [
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "get_vessel", "arguments": {"key": "v1"}}}, {"id": 4, "method": "tools/call", "params": {"name": "get_vesel"}},
        {"id": 5, "method": "resources/list"}, {"id": 6, "method": "tools/call", "params": {"name": 5}}, {"id": "p", "method": "ping"},
    ]
    lines = [json.dumps({"jsonrpc": "2.0", **m}) for m in asked] + ["nonsense", "", "[]", '{"id": 9}']
    assert serve_stdio("port", tools(o, Resolver(o, {"main": store})), StringIO("\n".join(lines)), out) == 11
    a = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in a] == [1, 2, 3, 4, 5, 6, "p", None, None, None]
    assert a[0]["result"]["protocolVersion"] == "2025-03-26" and a[0]["result"]["serverInfo"]["name"] == "port" and "Read only" in a[0]["result"]["instructions"]
    assert len(a[1]["result"]["tools"]) == 8 and json.loads(a[2]["result"]["content"][0]["text"])["found"] and a[3]["result"]["isError"]
    assert [x["error"]["code"] for x in (a[4], a[5], a[7], a[8], a[9])] == [-32601, -32602, -32700, -32600, -32600] and a[6]["result"] == {}


def test_negotiation():
    weak = negotiate.Capabilities("weak", joins=False, case_insensitive_like=False)
    assert len(negotiate.unmet(harbour.ontology(), weak)) == 2 and negotiate.unmet(harbour.ontology()) == []
    with pytest.raises(StrataError):
        negotiate.check(harbour.ontology(), weak)


@pytest.mark.parametrize("raw, says", [
    ({}, "no catalogs"), ({"catalogs": {"a": {"type": "parqet", "path": "x"}}}, "did you mean 'parquet'"), ({"catalogs": {"a": {"type": "store"}}}, "'path' is missing"),
    ({"catalogs": {"a": {"type": "spark"}}, "enigne": {}}, "did you mean 'engine'"), ({"catalogs": {"a": {"type": "spark"}}, "engine": {"type": "x"}}, "the type is spark"),
    ({"catalogs": {"a": {"type": "spark"}}, "mcp": {"transport": "http", "host": "0.0.0.0", "allow_writes": True}}, "need authentication"),
    ({"catalogs": {"a": {"type": "spark"}}, "governance": {"edit_log": "maybe"}}, "edit_log"), ({"catalogs": {"a": {"type": "spark"}}, "mcp": {"auth": {}}}, "carry no token"),
    ({"catalogs": {"a": {"type": "spark"}}, "mcp": {"transport": "http", "auth": {"issuer": "i", "audience": "a"}}}, "'jwks_uri' is missing"),
    ({"catalogs": {"a": {"type": "spark"}}, "mcp": {"transport": "http", "port": "x"}}, "port"),
    ({"catalogs": {"a": {"type": "spark"}}, "mcp": {"transport": "http", "auth": {"issuer": "i", "audience": "a", "jwks_uri": "http://far.org/k"}}}, "must be https"),
    ({"catalogs": {"a": {"type": "spark"}}, "mcp": {"transport": "http", "auth": {"issuer": "i", "audience": "a", "jwks_uri": "/k", "clock_skew": 9999}}}, "clock_skew"),
])
def test_config_refused(raw, says):
    with pytest.raises(SpecErrors, match=says):
        config.parse(raw)


def test_command_line(spark, store, tmp_path, capsys):
    root = write_spec(tmp_path / "spec", harbour.documents())
    cfg = tmp_path / "strataview.yaml"
    cfg.write_text(yaml.safe_dump({"catalogs": {"main": {"type": "store", "path": str(store.root)}}, "governance": {"edit_log": "required"}}))

    def run(*args, code=0):
        assert cli.main([args[0], str(root), *(["--config", str(cfg)] if args[0] != "validate" or "--physical" in args else []), *args[1:]], spark) == code
        return capsys.readouterr().out

    assert "2 object types" in run("validate") and "match" in run("validate", "--physical")
    assert json.loads(run("query", "Vessel", "--key", "v1"))["name"] == "Albatross"
    assert len(run("query", "Vessel", "--filter", "state=sailing", "--filter", "tonnage.gt=100").splitlines()) == 1
    assert len(run("query", "Vessel", "--key", "v1", "--link", "voyages").splitlines()) == 2
    assert run("query", "Vessel", "--key", "zz", code=1).strip() == "not found"
    assert "did you mean" in run("query", "Vesel", code=1)
    assert json.loads(run("run", "setState", "--param", "vessel=v2", "--param", "next=sailing"))["status"] == "applied"
    assert store.exists(LOG)
    assert "Nothing to change" in run("plan") or "not declared" in run("plan")
    assert "applied, version 1" in run("apply", "--yes") and "up-to-date" in run("apply", "--yes")
    assert "up-to-date" in run("rollback", "--to", "1", "--yes")


def test_append_under_contention(store, spark, monkeypatch):
    """Files are written once, the version is fought for a bounded number of times."""
    commit, lost = TableStore.commit, []

    def crowded(self, name, files, schema, parent, notes=None):
        if len(lost) < 3:
            lost.append(parent)
            raise ConflictError(name, parent, parent + 1)
        return commit(self, name, files, schema, parent, notes)

    monkeypatch.setattr(TableStore, "commit", crowded)
    store.append_rows("port.vessels", [{"imo": "v8"}])
    assert len(lost) == 3 and row(store, "v8")["imo"] == "v8"
    monkeypatch.setattr(TableStore, "commit", lambda self, name, files, schema, parent, notes=None: (_ for _ in ()).throw(ConflictError(name, parent, 0)))
    with pytest.raises(ConflictError):
        store.append_rows("port.vessels", [{"imo": "v9"}])
    monkeypatch.setattr(TableStore, "commit", commit)
    kept = {f.split("/")[0] for f in store.manifest("port.vessels")["files"]}
    assert {p.name for p in (store.root / "port.vessels" / "data").iterdir()} == kept and all(TableStore(spark, f"{x}{store.root}").root == store.root for x in ("", "file:", "file://"))


def test_edit_logs_are_kept_by_catalog(spark, tmp_path):
    """Vessels and voyages in two stores: each run is recorded where its row is; a folder of files can't hold a required log."""
    docs = harbour.documents()
    docs[1]["objectType"]["backing"]["catalog"] = "sea"
    from strataview.spec import from_documents

    o = from_documents(docs)
    both = harbour.store(spark, tmp_path / "a"), harbour.store(spark, tmp_path / "b")
    stores = dict(zip(("main", "sea"), both, strict=True))
    raw = {"catalogs": {k: {"type": "store", "path": str(s.root)} for k, s in stores.items()}, "governance": {"edit_log": "required"}}
    logs = config.parse(raw).logs(o, stores)
    rt = Runtime(o, stores, bind([], o).select(), logs, clock=lambda: harbour.day(20))
    assert rt.run("depart", {"nr": "t9", "vessel": "v1", "fare": "1.00"}).ok and rt.run("scrap", {"vessel": "v7"}).ok
    assert [[r.action for r in logs[k].history().collect()] for k in ("main", "sea")] == [["scrap"], ["depart"]]
    raw["catalogs"]["sea"] = {"type": "parquet", "path": str(tmp_path)}
    cfg = config.parse(raw)
    with pytest.raises(PolicyError, match="'sea' can't hold one"):
        cfg.logs(o, cfg.open(spark))
    alone = config.parse({"catalogs": {"a": {"type": "parquet", "path": str(tmp_path)}}, "governance": {"edit_log": "required"}})
    with pytest.raises(PolicyError, match="no catalog can hold one"):
        alone.logs(from_documents(docs[:1]), alone.open(spark))


def test_edit_log_is_compacted(store, monkeypatch):
    """Many runs leave few files, and lose no row; older versions stay readable."""
    from strataview.actions import log as module

    monkeypatch.setattr(module, "FILES", 3)
    log = EditLog(store)
    rt = runtime(store, log=log)
    for k in range(9):
        rt.run("scrap", {"vessel": f"x{k}"})
    assert log.history().count() == 9 and len(store.manifest(LOG)["files"]) <= 4
    assert store.table(LOG, store.version(LOG) - 3).count() < 9 and store.compact(LOG, 99) is None
