"""Customers whose orders have no lines: fits, rules and categories."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.operators import models, records
from tidemark.plans import load_all
from tidemark.plans.registry import ORACLE, QUERIES
from tidemark.sources import adapters as ad

SF = "/root/testdata/sf0.001"
load_all()


def test_logistic_fit_takes_missing_numbers_as_zero(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 4), float("nan") if i % 5 == 0 else float(i % 5), "xy"[i % 2], int(i % 3 == 0)) for i in range(60)]
    schema = "id int, a double, b double, c string, y int"
    full = [(i, a or 0.0, 0.0 if b != b else b, c, y) for i, a, b, c, y in rows]
    scored = [{r["id"]: r["p"] for r in models.probability(
        models.logistic_pipeline(["a", "b"], ["c"], "y", len(d)).fit(df), df, "p").collect()}
        for d in (rows, full) for df in [spark.createDataFrame(d, schema)]]
    assert scored[0] == pytest.approx(scored[1], abs=1e-9) and all(0 < p < 1 for p in scored[0].values())


def test_a_missing_category_count_is_wrong_only_where_it_must_be_scored(spark):
    df = spark.createDataFrame([(None,), (0,), (3,), (9,)], "category_count int")
    name = "category_count: outside the catalog"
    for allowed, want in ((True, [False, True, False, True]), (False, [True, True, False, True])):
        rules = [r for r in records.customer_rules({}, categories=5, without_lines=allowed) if r[0] == name]
        assert [bool(r["errors"]) for r in records.with_errors(df, rules).collect()] == want


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """The smallest tables without the lines of every fourth customer's orders."""
    out = tmp_path_factory.mktemp("bare")
    con = duckdb.connect()
    for t in ad.SUPPLIED.keys() | {"supplier"}:
        where = (f" WHERE l_orderkey NOT IN (SELECT o_orderkey FROM '{SF}/orders.parquet' WHERE o_custkey % 4 = 1)"
                 if t == "lineitem" else "")
        con.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet'{where}) TO '{out}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    con.sql("SET TimeZone='UTC'")
    return str(out), con


@pytest.mark.parametrize("name", ["a20_future_categories", "v21_record_rules"])
def test_queries_match_their_sql_without_lines(spark, bare, name):
    path, con = bare
    got = QUERIES[name](spark, path)
    want = con.sql(ORACLE[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
