"""Operators that keep to DataFrame and SQL functions: no Python in their plans."""

import pytest

import __spark_entry__ as driver


@pytest.mark.parametrize("name", ["op2_sharding", "op5_chat_formatting", "op6_url_filters"])
def test_no_python_in_the_plan(name, spark, folder):
    text = driver.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
