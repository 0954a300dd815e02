"""Windows of a panel are two parts per key, however long they are and however many scenarios share them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import moment_tree as mt

DAY = dt.date(2020, 1, 1)


def _at(k):
    return None if k is None else DAY + dt.timedelta(days=k)


def test_a_window_is_two_parts_and_equal_windows_are_one(spark):
    rows = [(f"K{a}", _at(k), (1e6 if k < 40 else 0.0) + (k * 37 % 11) * 1e-3) for a in range(70) for k in range(0, 90, 1 + a % 3)]
    returns = spark.createDataFrame(rows, "asset string, date date, log_return double")
    bounds = [(a, a + n) for a in range(-3, 90, 9) for n in (0, 1, 20, 63)] + [(None, 10), (40, None), (None, None), (95, 99), (8, 7)]
    windows = spark.createDataFrame([(i, _at(a), _at(b)) for i, (a, b) in enumerate(bounds * 2)], "scenario_id long, window_start date, window_end date")
    low, high = F.coalesce(mt._day(F.col("window_start")), F.lit(-1)), F.coalesce(mt._day(F.col("window_end")) + 1, F.lit(1 << 40))
    distinct = windows.select(low.alias("_low"), high.alias("_high")).filter("_low < _high").distinct()
    cuts = mt._cuts(distinct)
    placed = mt._placed(distinct, cuts)
    assert placed.count() == len(set(bounds)) - 1
    cells = mt._cells(returns, cuts, "asset", "date", "log_return")
    parts = mt._parts(cells, placed, "asset", 3)
    for place in ("_a", "_b"):
        met = placed.join(parts.withColumnRenamed("_pos", place), ["_level", place]).groupBy("_low", "_high").agg(F.sum(F.size("_keys")).alias("n"))
        assert {r.n for r in met.collect()} == {70}
    got = {(r.scenario_id, r.asset): (r.n, r["mean"], r.square) for r in mt.window_moments(returns, windows).collect()}
    want = {}
    by_key = {}
    for a, d, v in rows:
        by_key.setdefault(a, []).append((d, v))
    for i, (a, b) in enumerate(bounds * 2):
        for key, own in by_key.items():
            x = np.array([v for d, v in own if (a is None or d >= _at(a)) and (b is None or d <= _at(b))])
            if len(x):
                want[i, key] = (len(x), x.mean(), ((x - x.mean()) ** 2).sum())
    assert set(got) == set(want)
    for k, (n, mean, square) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(mean, rel=1e-12, abs=1e-15) and got[k][2] == pytest.approx(square, rel=1e-7, abs=1e-9)
