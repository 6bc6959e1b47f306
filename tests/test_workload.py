import pytest
from compare import spark_rows, sql_rows

from sievewright.workload import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(SQL[name], sf_dir)


def test_check_finds_nothing(spark, sf_dir):
    assert all(r["ok"] for r in QUERIES["index_check"](spark, sf_dir).collect())


def test_explain_names_routes(spark, sf_dir):
    plans = [r["plan"] for r in QUERIES["index_explain"](spark, sf_dir).orderBy("n").collect()]
    assert "route bitmap" in plans[0] and "2 qual(s), route bitmap" in plans[1] and "can't be answered" in plans[2]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["and_2"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linestatus,F)" in plan and "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
