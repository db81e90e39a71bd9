"""Types, expressions and the specification, without Spark jobs."""

from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
import yaml

from strataview.errors import SpecErrors
from strataview.functions.evaluate import EvalError, MissingClaim, Scope, evaluate
from strataview.functions.expr import Binary, Call, ExprError, Literal, Ref, Unary, parse
from strataview.spec import build, from_documents
from strataview.types import PropType, coerce, comparable, promotable

from . import harbour

DEC = PropType("decimal", precision=5, scale=2)


@pytest.mark.parametrize(
    "kind, value, want",
    [
        ("int", "42", 42), ("long", 4.0, 4), ("double", "1.5", 1.5), ("boolean", "TRUE", True), ("boolean", 0, False), ("string", 7, "7"),
        ("date", "2026-01-04", date(2026, 1, 4)), ("date", datetime(2026, 1, 4, 9), date(2026, 1, 4)),
        ("timestamp", "2026-01-04T12:00:00", datetime(2026, 1, 4, 12, tzinfo=timezone.utc)), ("int", None, None),
    ],
)
def test_coerce(kind, value, want):
    assert coerce(PropType(kind), value) == want


@pytest.mark.parametrize("t, value", [
    (PropType("int"), True), (PropType("int"), 1.5), (PropType("boolean"), "maybe"), (PropType("enum", ("a", "b")), "c"), (DEC, 1.5), (DEC, "1.005"),
    (DEC, "12345"), (DEC, "NaN"), (DEC, "x"), (PropType("date"), "soon"), (PropType("long"), "1e3"),
])
def test_coerce_refuses(t, value):
    with pytest.raises(ValueError):
        coerce(t, value)


def test_decimals_are_exact():
    assert coerce(DEC, "123.45") == Decimal("123.45") and coerce(DEC, 7) == Decimal(7)


def test_comparable_and_promotable():
    assert comparable("int", "double") and comparable("enum", "string") and not comparable("decimal", "long") and not comparable("date", "timestamp")
    assert promotable("int", "long") and promotable("float", "double") and not promotable("long", "int")


def test_parse_precedence():
    assert parse("1 + 2 * 3") == Binary("+", Literal(1), Binary("*", Literal(2), Literal(3)))
    assert parse("a || b && !c") == Binary("||", Ref(("a",)), Binary("&&", Ref(("b",)), Unary("!", Ref(("c",)))))
    assert parse("{{ object.state }}") == Ref(("object", "state"))
    assert parse("coalesce(a, 'x', null)") == Call("coalesce", (Ref(("a",)), Literal("x"), Literal(None)))


@pytest.mark.parametrize("text", ["", "1 +", "a b", "len()", "nope(1)", "'open", "{{ a }} b {{ c }}", "a..b", "now(1)", "(a"])
def test_parse_refuses(text):
    with pytest.raises(ExprError):
        parse(text)


def run(text, **kw):
    return evaluate(parse(text), Scope(**kw))


@pytest.mark.parametrize("text, want", [
    ("1 == 1.0", True), ("true == 1", False), ("null == null", True), ("1 != null", True), ("7 / 2", 3.5), ("'a' + 'b'", "ab"), ("len('été')", 3),
    ("upper('ab')", "AB"), ("coalesce(null, 3)", 3), ("false && (1 / 0 > 1)", False), ("true || (1 / 0 > 1)", True), ("-(2 - 5)", 3), ("2 < 2.5", True),
])
def test_evaluate(text, want):
    assert run(text) == want


@pytest.mark.parametrize("text", ["null < 1", "true < false", "1 / 0", "'a' + 1", "!1", "1 && true", "lower(1)", "'a' < 1", "x", "object.y"])
def test_evaluate_refuses(text):
    with pytest.raises(EvalError):
        run(text)


def test_dates_and_timestamps_share_an_axis():
    p = {"d": date(2026, 1, 4), "t": datetime(2026, 1, 4, tzinfo=timezone.utc), "x": Decimal("1.5")}
    assert run("d == t", params=p) and run("d <= t", params=p) and run("x > 1", params=p)
    with pytest.raises(EvalError):
        run("x * 1.5", params=p)


def test_claims():
    assert run("principal.groups contains 'a'", claims={"groups": ["a"]}) is True
    with pytest.raises(MissingClaim):
        run("principal.dept == 'x'", claims={})


def test_valid_specification():
    o = harbour.ontology()
    assert list(o.objects) == ["Vessel", "Voyage"] and o.objects["Vessel"].key.column == "imo"


def without(path, value):
    """The shop's documents with one place changed."""
    docs = harbour.documents()
    at = docs
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return docs


PROPS = [0, "objectType", "properties"]


@pytest.mark.parametrize("path, value, says", [
    ([0, "objectType", "primaryKey"], "nope", "names no property"), ([*PROPS, 0, "unique"], False, "unique"), ([*PROPS, 0, "nullable"], True, "nullable"),
    ([*PROPS, 1, "type"], "strin", "did you mean 'string'"), ([*PROPS, 1, "column"], "imo", "declared twice"), ([*PROPS, 2, "values"], [], "needs 'values'"),
    ([0, "objectType", "searchable"], ["nam"], "searchable"), ([0, "objectType", "colour"], 1, "unknown key"), ([0, "objectType", "title"], KeyError, "missing"),
    ([*PROPS, 1, "renamedFrom"], "call_name", "present name"), ([2, "linkType", "to", "property"], "tonnage", "can't be joined"), ([2, "linkType", "cardinality"], "many_to_many", "through"),
    ([2, "linkType", "from", "objectType"], "Voyag", "did you mean"), ([3, "action", "validation", 0, "rule"], "next", "expected boolean"),
    ([3, "action", "validation", 0, "rule"], "next > 1", "can't be compared"), ([3, "action", "effects", 0, "modifyObject", "set"], {"vesselId": "vessel"}, "primary key"),
    ([3, "action", "effects", 0, "modifyObject", "set"], {"state": "nope"}, "nothing is called"), ([5, "action", "effects", 0, "createObject", "set"], {"voyageId": "nr"}, "doesn't set"),
    ([3, "action", "operation"], "delete", "needs exactly one"), ([3, "action", "targetObjectType"], "X", "no object type"), ([3, "action", "validation", 0, "rule"], "principal.sub == 'x'", "caller"),
    ([3, "action", "parameters", 0, "objectType"], "X", "refers to no object type"), ([1, "objectType", "properties", 2, "scale"], 99, "precision"),
])
def test_invalid_specifications(path, value, says):
    with pytest.raises(SpecErrors) as e:
        from_documents(without(path, value))
    assert says in str(e.value)


def test_all_problems_at_once(tmp_path):
    docs = without([0, "objectType", "primaryKey"], "nope")
    docs[1]["objectType"]["title"] = "nope"
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.yaml").write_text(yaml.safe_dump(d))
    (tmp_path / "strataview.yaml").write_text("catalogs: {}")
    with pytest.raises(SpecErrors) as e:
        build(tmp_path)
    assert len(e.value.problems) >= 2


def test_link_names_must_not_collide():
    docs = harbour.documents()
    docs.append({"linkType": {**docs[2]["linkType"], "apiName": "again"}})
    with pytest.raises(SpecErrors, match="already leads"):
        from_documents(docs)


def test_fan_out_warns(tmp_path):
    docs = harbour.documents()[:3]
    docs[2]["linkType"]["cardinality"] = "one_to_one"
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.yaml").write_text(yaml.safe_dump(d))
    _, report = build(tmp_path)
    assert any("isn't declared unique" in w for w in report.warnings)
