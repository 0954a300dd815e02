"""Members of an ensemble are columns of one pass, and residual variances one pass over their errors."""

import pytest

from panelwright.operators.ewma import ewma_forecast, ewma_means
from panelwright.operators.returns import log_returns
from panelwright.plans import queries


def test_means_equal_the_forecasts_at_each_halflife(spark, long_walk):
    returns = log_returns(long_walk)
    got = {(r.asset, r.date): r for r in ewma_means(returns, {"slow": 63.0, "fast": 0.2}).collect()}
    for name, halflife in (("slow", 63.0), ("fast", 0.2)):
        want = {(r.asset, r.date): r.mu for r in ewma_forecast(returns, halflife=halflife).collect()}
        assert set(got) == set(want)
        assert all(got[k][name] == pytest.approx(mu, rel=1e-12, abs=1e-15) for k, mu in want.items())


def test_members_need_no_copies_of_the_panel(spark):
    plan = queries._member_predictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
