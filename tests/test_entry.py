import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100


def test_imports_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('lathework.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["agg_value_dims", "agg_fiscal_quarter", "pivot_margins", "compare_key", "dq_rules", "formula_math", "post_yoy", "ts_rolling"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "lineitem", "events"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    norm = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    got = sorted([[norm(r[c]) for c in cols] for r in entry.queries()[name](spark, SF).collect()], key=repr)
    assert got == sorted([[norm(r[i]) for i in at] for r in want.fetchall()], key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["agg_value_dims"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_comment" not in schema and "l_orderkey" not in schema and "l_quantity" in schema
    top = entry.queries()["agg_topn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["formula_window", "impute_ffill", "post_rolling", "compare_key"])
def test_no_window_sorts_a_table_in_one_task(spark, name):
    """A window without partitions runs over grouped rows or over one row for each range only."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "], [" not in line.split("windowspecdefinition")[-1]:
            assert "_part" in line or "b#" in line, line
