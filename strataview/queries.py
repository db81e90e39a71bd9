"""The registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import demo
from .functions.columns import quoted, strict
from .functions.expr import parse
from .migrate.plan import plan
from .operators import rollup
from .operators.governance import PolicySet, bind
from .sources.catalog import ParquetCatalog, ViewCatalog
from .spec import from_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CUSTOMER = "c_custkey AS customerId, c_name AS name, c_nationkey AS nationId, c_acctbal AS acctBal, c_mktsegment AS segment"
ORDER = "o_orderkey AS orderId, o_custkey AS customerId, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS orderedOn, o_orderpriority AS priority"
PART = "p_partkey AS partId, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price"
DOCUMENT = "d.doc_id AS docId, lang, source, n_chars AS chars"
SPARSE = "(SELECT c_custkey, c_name, c_nationkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)"


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = sql


def read(name: str, verb: Callable[[Any], DataFrame], sql: str, policies: list[dict] | None = None, claims: dict | None = None, nulls: bool = False) -> None:
    add(name, lambda s, d: verb(demo.resolver(s, d, policies, claims, nulls)), sql)


def paged(select: str, source: str, where: str = "true", order: str = "", limit: int = 50, offset: int = 0) -> str:
    return f"SELECT {select} FROM {source} WHERE {where} ORDER BY {order} NULLS LAST LIMIT {limit} OFFSET {offset}"


# get and list
read("get_by_key", lambda r: r.get_frame("Customer", "5"), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 5 LIMIT 2")
read("get_absent", lambda r: r.get_frame("Customer", -1), f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = -1")
read("list_page1", lambda r: r.list("Order"), paged(ORDER, "orders", order="o_orderkey"))
read("list_page3", lambda r: r.list("Order", 50, 100), paged(ORDER, "orders", order="o_orderkey", offset=100))
read("page_cap", lambda r: r.list("Order", 9999), paged(ORDER, "orders", order="o_orderkey", limit=500))


def search(name: str, kind: str, filters: Mapping[str, Any], where: str, nulls: bool = False, limit: int = 500) -> None:
    select, table, order = {"Customer": (CUSTOMER, SPARSE if nulls else "customer", "c_custkey"), "Order": (ORDER, "orders", "o_orderkey"), "Part": (PART, "part", "p_partkey")}[kind]
    read(name, lambda r: r.search(kind, filters, limit), paged(select, table, where, order, limit), nulls=nulls)


search("search_eq_enum", "Order", {"status": {"eq": "P"}}, "o_orderstatus IS NOT DISTINCT FROM 'P'")
search("search_ne_enum", "Customer", {"segment": {"ne": "BUILDING"}}, "c_mktsegment IS DISTINCT FROM 'BUILDING'")
search("search_gt", "Order", {"total": {"gt": 150000}}, "o_totalprice > 150000")
search("search_gte", "Order", {"total": {"gte": "150000.5"}}, "o_totalprice >= 150000.5")
search("search_lt", "Order", {"total": {"lt": 20000}}, "o_totalprice < 20000")
search("search_lte", "Order", {"total": {"lte": 20000}}, "o_totalprice <= 20000")
search("search_date_range", "Order", {"orderedOn": {"gte": "1996-02-01", "lt": "1996-03-01"}}, "o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-03-01'")
search("search_string_order", "Customer", {"name": {"gt": "Customer#000000100"}}, "c_name > 'Customer#000000100'")
search("search_contains", "Customer", {"name": {"contains": "CUSTOMER#00000012"}}, "c_name ILIKE '%CUSTOMER#00000012%'")
search("search_contains_meta", "Part", {"name": {"contains": "%_"}}, r"p_name ILIKE '%\%\_%' ESCAPE '\'")
search("search_bare_string", "Customer", {"name": "0007"}, "c_name ILIKE '%0007%'")
search("search_bare_enum", "Customer", {"segment": "BUILDING"}, "c_mktsegment IS NOT DISTINCT FROM 'BUILDING'")
search("search_bare_number", "Part", {"size": "7"}, "p_size = 7")
search("search_unsearchable_exact", "Part", {"brand": "Brand#11"}, "p_brand = 'Brand#11'")
search("search_multi_and", "Order", {"status": "O", "total": {"gt": 50000, "lt": 200000}, "customerId": {"lt": 300}}, "o_orderstatus = 'O' AND o_totalprice > 50000 AND o_totalprice < 200000 AND o_custkey < 300")
search("search_eq_null", "Customer", {"segment": {"eq": None}}, "c_mktsegment IS NULL", True)
search("search_ne_null", "Customer", {"acctBal": {"ne": None}}, "c_acctbal IS NOT NULL", True)
search("search_ne_value_nulls", "Customer", {"segment": {"ne": "BUILDING"}}, "c_mktsegment IS DISTINCT FROM 'BUILDING'", True)
search("search_gt_nulls", "Customer", {"acctBal": {"gt": 5000}}, "c_acctbal > 5000", True)
search("search_empty", "Order", {}, "true", limit=20)


def _decimal(spark: SparkSession, d: str) -> DataFrame:
    docs = [{"objectType": {
        "apiName": "Bill", "primaryKey": "billId", "title": "billId", "backing": {"catalog": "star", "table": "bill"}, "searchable": ["amount"],
        "properties": [{"name": "billId", "type": "long", "column": "id", "unique": True}, {"name": "amount", "type": "decimal", "precision": 12, "scale": 2, "column": "amount"}],
    }}]
    t = ParquetCatalog(spark, d).table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    from .plans.resolver import Resolver

    return Resolver(from_documents(docs), {"star": ViewCatalog({"bill": t})}).search("Bill", {"amount": {"gte": "100000.00", "lt": "120000.50"}}, 500).withColumn("amount", F.col("amount").cast("double"))


add(
    "search_decimal_range", _decimal,
    "SELECT o_orderkey AS billId, o_totalprice::DECIMAL(12,2)::DOUBLE AS amount FROM orders WHERE o_totalprice::DECIMAL(12,2) >= 100000.00 AND o_totalprice::DECIMAL(12,2) < 120000.50 ORDER BY 1 LIMIT 500",
)

# traverse
read("traverse_forward", lambda r: r.traverse("Order", 17, "placedBy"), f"SELECT {CUSTOMER} FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey = 17 ORDER BY c_custkey LIMIT 50")
read("traverse_reverse", lambda r: r.traverse("Customer", 5, "orders"), f"SELECT {ORDER} FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey = 5 ORDER BY o_orderkey LIMIT 50")
read("traverse_page2", lambda r: r.traverse("Nation", 3, "customers", 10, 10), f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 10 OFFSET 10")
read("traverse_empty", lambda r: r.traverse("Customer", 10**12, "orders"), f"SELECT {ORDER} FROM orders WHERE false")
read("traverse_m2m", lambda r: r.traverse("Order", 4, "contains", 500), f"SELECT {PART} FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_orderkey = 4 ORDER BY p_partkey LIMIT 500")
read("traverse_m2m_reverse", lambda r: r.traverse("Part", 7, "orderedIn", 500), f"SELECT {ORDER} FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = 7 ORDER BY o_orderkey LIMIT 500")
read("traverse_m2m_supplier", lambda r: r.traverse("Part", 7, "suppliedBy", 500), "SELECT s_suppkey AS supplierId, s_name AS name, s_nationkey AS nationId, s_acctbal AS acctBal FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_partkey = 7 ORDER BY s_suppkey LIMIT 500")
read("traverse_one_to_one", lambda r: r.traverse("Label", 1, "labelOf"), f"SELECT {DOCUMENT} FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id = 1")
read("traverse_self_link", lambda r: r.traverse("Customer", 5, "neighbours", 500), f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5) ORDER BY c_custkey LIMIT 500")


# governance
def rows(text: str, **more: Any) -> list[dict]:
    return [{"name": "p", "objectType": "Customer", "rows": text, **more}]


def policy(name: str, text: str, where: str, claims: dict | None = None) -> None:
    read(name, lambda r: r.list("Customer", 500), paged(CUSTOMER, SPARSE, where, "c_custkey", 500), rows(text), claims, True)


NO_BAL = "c_custkey AS customerId, c_name AS name, c_nationkey AS nationId, c_mktsegment AS segment"
MASK = {"name": "m", "objectType": "Customer", "mask": ["acctBal"]}
read("mask_projection", lambda r: r.list("Customer"), paged(NO_BAL, "customer", order="c_custkey"), [MASK])
policy("policy_rows_eq", "object.segment == 'BUILDING'", "c_mktsegment IS NOT DISTINCT FROM 'BUILDING'")
policy("policy_rows_ne", "object.segment != 'BUILDING'", "c_mktsegment IS DISTINCT FROM 'BUILDING'")
policy("policy_rows_not", "!(object.acctBal > 5000)", "NOT (c_acctbal > 5000)")
policy("policy_rows_and", "!(object.acctBal > 5000 && object.segment == 'BUILDING')", "NOT (c_acctbal > 5000 AND c_mktsegment IS NOT DISTINCT FROM 'BUILDING')")
policy("policy_rows_or", "object.acctBal >= 9000 || object.segment == 'FURNITURE'", "c_acctbal >= 9000 OR c_mktsegment IS NOT DISTINCT FROM 'FURNITURE'")
policy("policy_rows_colcol", "object.acctBal > object.customerId", "c_acctbal > c_custkey")
policy("policy_rows_null", "object.segment == null", "c_mktsegment IS NULL")
policy("policy_undecided_negation", "!(object.acctBal < 100)", "NOT (c_acctbal < 100)")
policy("policy_principal_fold", "object.segment == principal.dept", "c_mktsegment IS NOT DISTINCT FROM 'HOUSEHOLD'", {"sub": "u1", "dept": "HOUSEHOLD"})
policy("policy_missing_claim", "object.segment != principal.dept", "NULL::BOOLEAN", {"sub": "u1"})
policy("policy_missing_claim_or", "object.segment == principal.dept || object.nationId == 3", "NULL::BOOLEAN OR c_nationkey = 3", {"sub": "u1"})
read(
    "policy_conjunction", lambda r: r.list("Customer", 500), paged(CUSTOMER, "customer", "c_acctbal > 0 AND c_nationkey < 10", "c_custkey", 500),
    [{"name": "a", "objectType": "Customer", "rows": "object.acctBal > 0"}, {"name": "b", "objectType": "Customer", "rows": "object.nationId < 10"}],
)
read("policy_filter_on_masked", lambda r: r.list("Customer", 500), paged(NO_BAL, "customer", "c_acctbal > 5000", "c_custkey", 500), [MASK, {"name": "b", "objectType": "Customer", "rows": "object.acctBal > 5000"}])
read("policy_before_page", lambda r: r.list("Customer", 20, 40), paged(CUSTOMER, "customer", "c_mktsegment IS DISTINCT FROM 'BUILDING'", "c_custkey", 20, 40), rows("object.segment != 'BUILDING'"))
read("policy_traverse_anchor_hidden", lambda r: r.traverse("Customer", 5, "orders"), f"SELECT {ORDER} FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey = 5 AND c_custkey > 5 ORDER BY 1", rows("object.customerId > 5"))
read("policy_traverse_target_hidden", lambda r: r.traverse("Nation", 3, "customers", 500), f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey = 3 AND c_acctbal > 1000 ORDER BY c_custkey LIMIT 500", rows("object.acctBal > 1000"))
GUARDED = rows("object.segment == 'BUILDING'", when="principal.groups contains 'desk'")
BUILDING = "c_mktsegment IS NOT DISTINCT FROM 'BUILDING'"
read("policy_guard_true", lambda r: r.list("Customer", 500), paged(CUSTOMER, "customer", BUILDING, "c_custkey", 500), GUARDED, {"sub": "u", "groups": ["desk"]})
read("policy_guard_false", lambda r: r.list("Customer", 500), paged(CUSTOMER, "customer", "true", "c_custkey", 500), GUARDED, {"sub": "u", "groups": ["other"]})
read("policy_guard_undecided", lambda r: r.list("Customer", 500), paged(CUSTOMER, "customer", BUILDING, "c_custkey", 500), GUARDED, {"sub": "u"})


# expressions over whole tables
def expr(name: str, text: str, sql: str, kind: str = "string", nulls: bool = True) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        x = demo.ontology().objects["Customer"]
        t = (demo.sparse(s, d) if nulls else ParquetCatalog(s, d)).table("customer")
        c = strict(parse(text), lambda n: quoted(x.props[n].column), {}, datetime(2026, 1, 4, tzinfo=timezone.utc), {n for n, p in x.props.items() if p.type.kind in ("string", "enum")})
        return t.select(F.col("c_custkey").alias("customerId"), c.cast(kind).alias("v"))

    add(name, query, f"SELECT c_custkey AS customerId, {sql} AS v FROM {SPARSE}")


expr("expr_lower", "lower(object.segment)", "lower(c_mktsegment)")
expr("expr_upper", "upper(object.name)", "upper(c_name)")
expr("expr_len", "len(object.segment)", "length(c_mktsegment)::BIGINT", "bigint")
expr("expr_coalesce", "coalesce(object.segment, object.name, 'none')", "coalesce(c_mktsegment, c_name, 'none')")
expr("expr_concat", "lower(object.name) + '-' + object.segment", "lower(c_name) || '-' || c_mktsegment")
expr("expr_concat_props", "object.name + object.segment", "c_name || c_mktsegment")
expr("expr_arith", "object.acctBal * 2 + object.nationId - 1", "c_acctbal * 2 + c_nationkey - 1", "double")
expr("expr_div", "object.acctBal / object.nationId", "CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END", "double")
expr("expr_neg", "-object.acctBal", "-c_acctbal", "double")
expr("expr_not", "!(object.acctBal > 100)", "NOT (c_acctbal > 100)", "boolean")
expr("expr_compare_null_safe", "object.segment != 'BUILDING'", "c_mktsegment IS DISTINCT FROM 'BUILDING'", "boolean")
expr("expr_shortcircuit", "object.acctBal > 5000 && object.segment == 'BUILDING'", "CASE WHEN c_acctbal > 5000 IS NULL THEN NULL WHEN NOT (c_acctbal > 5000) THEN false ELSE c_mktsegment IS NOT DISTINCT FROM 'BUILDING' END", "boolean")
expr("expr_shortcircuit_or", "object.acctBal > 5000 || object.segment == 'BUILDING'", "CASE WHEN c_acctbal > 5000 IS NULL THEN NULL WHEN c_acctbal > 5000 THEN true ELSE c_mktsegment IS NOT DISTINCT FROM 'BUILDING' END", "boolean")
expr("expr_now", "now() == now()", "true", "boolean")


def _violations(spark: SparkSession, d: str) -> DataFrame:
    x = demo.ontology().objects["Customer"]
    rule = strict(parse("object.acctBal > 0 && object.segment != 'MACHINERY'"), lambda n: quoted(x.props[n].column))
    return ParquetCatalog(spark, d).table("customer").where(~rule).select(F.col("c_custkey").alias("customerId"))


add("rule_violations", _violations, "SELECT c_custkey AS customerId FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment <> 'MACHINERY')")


# rollup
def _shown(df: DataFrame) -> DataFrame:
    """The exact decimal and the date in forms that every client reads alike."""
    return df.withColumns({"gross_sales": F.col("gross_sales").cast("double"), "sales_date": F.col("sales_date").cast("string")})


SHOWN = "SELECT sales_date::VARCHAR AS sales_date, gross_sales::DOUBLE AS gross_sales, order_count, unique_customers FROM"


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.daily(ParquetCatalog(spark, d).table("orders"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_custkey"))


ROLLUP = "SELECT o_orderdate::DATE AS sales_date, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(14,2) AS gross_sales, count(*) AS order_count, count(DISTINCT o_custkey) AS unique_customers FROM orders GROUP BY 1"
add("daily_rollup", lambda s, d: _shown(_rollup(s, d).orderBy("sales_date")), f"{SHOWN} ({ROLLUP})")
add("rollup_range_search", lambda s, d: _shown(_rollup(s, d).where("sales_date >= date'1996-01-01' and sales_date < date'1996-07-01'")), f"{SHOWN} ({ROLLUP}) WHERE sales_date >= DATE '1996-01-01' AND sales_date < DATE '1996-07-01'")
add("rollup_max_version", lambda s, d: _rollup(s, d).agg(F.max("order_count").alias("v")), f"SELECT max(order_count) AS v FROM ({ROLLUP})")


# writes and migrations, through the versioned store in the shared folder
def _stored(spark: SparkSession, d: str, name: str, df: DataFrame):
    import tempfile

    from .sources.store import TableStore

    store = TableStore(spark, tempfile.mkdtemp(prefix="store-", dir=_folder(spark)))
    store.create(name, StructType([StructField(f.name, f.dataType, True) for f in df.schema]))
    store.append(name, df)
    return store


def _folder(spark: SparkSession) -> str | None:
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if not root.startswith("/"):
        return None
    import os

    os.makedirs(root, exist_ok=True)
    return root


PLAIN = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _modify(spark: SparkSession, d: str) -> DataFrame:
    t = ParquetCatalog(spark, d).table("customer")
    store = _stored(spark, d, "customer", t)
    v = store.version("customer")
    row = store.table("customer", v).where("c_custkey = 5").first().asDict()
    store.replace_row("customer", "c_custkey", 5, {**row, "c_mktsegment": "FURNITURE"}, v)
    return store.table("customer").select(*PLAIN.split(", "))


def _delete(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d, "customer", ParquetCatalog(spark, d).table("customer"))
    store.delete_row("customer", "c_custkey", 5, store.version("customer"))
    return store.table("customer").select(*PLAIN.split(", "))


def _create(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d, "customer", ParquetCatalog(spark, d).table("customer"))
    store.insert_row("customer", {"c_custkey": 0, "c_name": "New", "c_nationkey": 1, "c_acctbal": 1.5, "c_mktsegment": None}, store.version("customer"))
    return store.table("customer").select(*PLAIN.split(", "))


def _carry(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d, "events", ParquetCatalog(spark, d).table("events"))
    v = store.version("events")
    row = store.table("events", v).where("event_id = 7").first().asDict()
    store.replace_row("events", "event_id", 7, {**row, "value": 0.25}, v)
    return store.table("events")


add("modify_post_image", _modify, f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey = 5 THEN 'FURNITURE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add("delete_post_image", _delete, f"SELECT {PLAIN} FROM customer WHERE c_custkey <> 5")
add("create_post_image", _create, f"SELECT {PLAIN} FROM customer UNION ALL SELECT 0, 'New', 1, 1.5, NULL")
add("carry_across", _carry, "SELECT * REPLACE (CASE WHEN event_id = 7 THEN 0.25 ELSE value END AS value) FROM events")


def _rename(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d, "nation", ParquetCatalog(spark, d).table("nation").select("n_nationkey", "n_name"))
    store.alter("nation", add=[StructField("note", StringType())], rename={"n_name": "label"})
    return store.table("nation").select("n_nationkey", "label", "note")


def _promote(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d, "nation", ParquetCatalog(spark, d).table("nation").select("n_nationkey", "n_regionkey"))
    store.alter("nation", promote={"n_regionkey": LongType()})
    return store.table("nation").select("n_nationkey", F.col("n_regionkey"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a spec whose customers gain a column and whose order totals are retyped."""
    docs = [{"objectType": {
        "apiName": "Nation", "primaryKey": "id", "title": "id", "backing": {"catalog": "star", "table": "nation"},
        "properties": [
            {"name": "id", "type": "long", "column": "n_nationkey", "unique": True}, {"name": "label", "type": "string", "column": "label", "renamedFrom": "n_name", "nullable": True},
            {"name": "note", "type": "string", "column": "note", "nullable": True}, {"name": "region", "type": "string", "column": "n_regionkey", "nullable": True},
        ],
    }}]
    p = plan(from_documents(docs), {"star": ParquetCatalog(spark, d)})
    return spark.createDataFrame([(c.op, c.column, c.severity) for c in p.changes], "op string, col string, severity string")


add("rename_preserves_rows", _rename, "SELECT n_nationkey, n_name AS label, NULL::VARCHAR AS note FROM nation")
add("promote_preserves_rows", _promote, "SELECT n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation")
add(
    "plan_changes", _plan,
    "SELECT * FROM (VALUES ('promote', 'n_nationkey', 'physical-safe'), ('tighten', 'n_nationkey', 'breaking'), ('rename', 'label', 'physical-safe'), "
    "('add', 'note', 'safe'), ('retype', 'n_regionkey', 'breaking')) t(op, col, severity)",
)


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return ParquetCatalog(spark, d).scan("customer", ["c_custkey", "c_name"], [("c_mktsegment", "BUILDING"), ("c_nationkey", 3)])


def _admit(spark: SparkSession, d: str) -> DataFrame:
    """The write plane's gate: the same policy as a column, false where it is undecided."""
    program = bind(rows("object.acctBal > 5000"), demo.ontology())
    decided: PolicySet = program.select()
    return demo.sparse(spark, d).table("customer").select(F.col("c_custkey").alias("customerId"), decided.admits(demo.ontology().objects["Customer"]).alias("admitted"))


add("scan_equality", _scan, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
add("policy_admission_gate", _admit, f"SELECT c_custkey AS customerId, coalesce(c_acctbal > 5000, false) AS admitted FROM {SPARSE}")
add("flagship", demo.flagship, paged(NO_BAL, "customer", "c_nationkey = 7 AND c_mktsegment IS DISTINCT FROM 'MACHINERY'", "c_custkey", 100))
