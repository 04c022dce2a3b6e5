import pytest

from headmint.plans.oracles import ORACLES
from headmint.plans.queries import QUERIES
from tests.comparing import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(small, ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert {r["address_role"] for r in e.entry(spark).collect()} == {"sender", "account_email", "to_recipients", "cc_recipients", "bcc_recipients"}
    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())


def test_scans_are_pruned_and_filtered(spark, small):
    plan = QUERIES["parquet_columns"](spark, small)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_addresses_scan_once_without_python(spark, small):
    plan = QUERIES["parse_rates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and plan.count("Generate") == 1
