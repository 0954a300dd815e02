"""Forecasts of supplier bars run in the tasks that the bars' one exchange deals out, however many those are."""

import pytest

from panelwright.operators import layout
from panelwright.plans.queries import REGISTERED


@pytest.mark.parametrize("name", ["ewma_forecasts", "idzorek_confidence"])
def test_forecasts_keep_the_tasks_sized_by_the_input(spark, monkeypatch, name):
    monkeypatch.setattr(layout, "BYTES_PER_TASK", 4096, raising=False)
    found = REGISTERED[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert found.rdd.getNumPartitions() > max(4, spark.sparkContext.defaultParallelism)
