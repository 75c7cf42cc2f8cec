import datetime
import decimal
import os

import duckdb
import pytest

from tallyframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return str(value.normalize() + 0)
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_plans_have_no_nested_loops_or_single_tasks(spark, duck):
    for name in ("month_category_deltas", "ledger_diff", "parse_rendered_log", "adjacent_duplicates"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        if name != "month_category_deltas":  # one log's distinct months are one group, of a few rows
            assert "SinglePartition" not in plan, name


def test_scans_read_few_columns(spark, duck):
    plan = registry.QUERIES["treatment_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_every_event_is_repeated(spark, duck):
    n = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    assert registry.QUERIES["repeated_trials_all"](spark, SF).count() == 3 * n


def test_every_answered_call_is_paired(spark, duck):
    # a call is answered if an assistant's turn comes before the next call
    answered = duck.execute("SELECT count(*) FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user' AND following = 'assistant'").fetchone()[0]
    first = registry.QUERIES["call_output_pairing"](spark, SF).count()
    assert registry.QUERIES["call_output_pairing_all"](spark, SF).count() == answered > first


def test_refund_lines_come_from_the_reconciliation(spark, duck, monkeypatch):
    monkeypatch.setattr(registry.totals, "reconciliation", lambda *a, **k: spark.createDataFrame([([7, 9],)], "refunds array<long>"))
    assert [r.c_custkey for r in registry.QUERIES["refund_lines"](spark, SF).collect()] == [7, 9]


def test_selections_are_numbered_over_all_orders(spark, tmp_path):
    keys = [9001, 5, 20000, 7, 8]  # in three blocks
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.log: r.problems for r in registry.QUERIES["selection_problems"](spark, str(tmp_path)).collect()}
    repeated, more = "ids are not three distinct ones", "unsupported ids,required ids omitted"
    assert got == {1: repeated, 2: more, 4: repeated}
