import pytest

from headmint.llm.oracles import ORACLES
from headmint.llm.queries import PARTS, QUERIES
from tests.comparing import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert spark_rows((QUERIES | PARTS)[name](spark, small)) == duck_rows(small, ORACLES[name])


@pytest.mark.parametrize("name", ["op4_decontaminate", "op9_secret_scan"])
def test_native_queries_run_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_every_operator_has_a_query():
    import __spark_entry__ as e

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(QUERIES) | set(PARTS) | {"pipeline"} <= set(e.queries())
