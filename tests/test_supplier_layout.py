"""Supplier bars lie by asset from the start, in tasks whose number follows the input."""

from panelwright.operators import layout
from panelwright.operators.returns import log_returns
from panelwright.sources.derived import supplier_prices


def test_bars_and_returns_share_one_exchange_sized_by_the_input(spark, monkeypatch):
    monkeypatch.setattr(layout, "BYTES_PER_TASK", 4096)
    bars = supplier_prices(spark, "/root/testdata/sf0.001")
    assert bars.rdd.getNumPartitions() > max(4, spark.sparkContext.defaultParallelism)
    plan = log_returns(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
