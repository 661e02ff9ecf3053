"""Every bound query against its SQL, and what its plan must not contain."""

import re

import duckdb
import pytest

from bindings.all_queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Queries that run a stream or write files while they are built; their plan is only the read back.
WITH_ACTIONS = {
    "track_transitions", "track_transitions_live", "track_update", "outcome_of_create", "outcome_of_delete", "plan_actions", "node_state_stream",
    "scan_tool_text", "write_report", "append_results", "scan_inventory", "order_pages", "page_walks", "late_rows",
}


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_the_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    cursor = sql.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    key = lambda row: [(type(v).__name__, str(v)) for v in row]
    assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_ACTIONS))
def test_plan_has_no_cross_join_python_or_single_task_window(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert banned not in plan, banned
    assert not re.search(r"Window .*\n.*Exchange SinglePartition", plan)


def test_filters_reach_the_scan(spark, data):
    plan = QUERIES["cost_by_tag"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,2000-08-01" in plan and "LessThan(l_shipdate,2001-08-01" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


def test_top_n_is_pruned_before_each_shuffle(spark, data):
    plan = QUERIES["log_tail"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") == 2


def test_entry_point(spark, data, monkeypatch):
    import __spark_entry__ as entry

    core = set(QUERIES)
    assert core <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setattr(entry, "SMOKE_DIR", data)
    assert entry.entry(spark).columns == ["cluster", "owner", "region", "total", "status", "error"]


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_point_without_the_optional_package(tmp_path, left):
    """Without the text operators the rest imports, whether or not their pipeline is still there."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.mkdir(tmp_path / "fleetloom")
    pairs = [(os.path.join(root, item), tmp_path / item) for item in ("__spark_entry__.py", "bindings", *left) if os.path.exists(os.path.join(root, item))]
    pairs += [(os.path.join(root, "fleetloom", item), tmp_path / "fleetloom" / item) for item in os.listdir(os.path.join(root, "fleetloom")) if item != "llm"]
    for source, target in pairs:
        os.symlink(source, target)
    # a symbolic link would lead back to the whole repository
    entry = tmp_path / "__spark_entry__.py"
    code = open(entry).read()
    entry.unlink()
    entry.write_text(code)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) - len(e.QUERIES), 'pipeline' in e.queries(), set(e.oracle_sql()) == set(e.queries()))"],
        cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True,
    )
    assert said.stdout.split() == ["0", "False", "True"], said.stderr
