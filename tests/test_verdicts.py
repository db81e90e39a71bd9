"""Queries that run actions, refusals, migrations and surfaces, against their SQL."""

import duckdb
import pytest

from strataview import queries, verdicts

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.QUERIES if n.endswith("_verdicts") or n.startswith(("action_", "edit_log", "rollup_refreshed"))] + ["carry_across", "expr_concat_props"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("customer", "orders", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sql.execute(f"select {', '.join(columns)} from ({queries.ORACLE[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_every_verdict_query_is_registered():
    assert verdicts and len(NAMES) >= 18 and all(n in queries.ORACLE for n in queries.QUERIES)
