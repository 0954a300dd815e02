import datetime as dt

import pytest
from conftest import frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators import ingest as ing
from panelwright.sources.panel_store import normalize_bars, read_panel, rewrite_years, slice_panel, write_panel

D = dt.date
P = "asset string, date date, adj_close double"


def bars(spark, *rows):
    return spark.createDataFrame([(a, D(2024, 1, d), p) for a, d, p in rows], P)


def test_store_round_trip_and_pushdown(spark, walk, tmp_path):
    path = str(tmp_path / "panel")
    write_panel(walk, path)
    got = read_panel(spark, path, ["SPY"], "2026-02-02", "2026-02-04")
    assert [str(r["date"]) for r in got.orderBy("date").collect()] == ["2026-02-02", "2026-02-03"]
    plan = got._jdf.queryExecution().toString()
    assert "EqualTo(asset,SPY)" in plan and "GreaterThanOrEqual(date" in plan
    assert slice_panel(walk).count() == 210


def test_rewriting_touches_only_given_years(spark, tmp_path):
    path = str(tmp_path / "panel")
    first = spark.createDataFrame([("a", D(2022, 5, 1), 1.0), ("a", D(2023, 5, 1), 2.0)], P)
    rewrite_years(spark, path, first, ["asset", "date"])
    kept = sorted((tmp_path / "panel" / "year=2022").glob("*.parquet"))
    rewrite_years(spark, path, spark.createDataFrame([("a", D(2023, 5, 1), 9.0), ("b", D(2023, 6, 1), 3.0)], P), ["asset", "date"])
    assert sorted((tmp_path / "panel" / "year=2022").glob("*.parquet")) == kept
    got = {(r["asset"], r["date"].year): r["adj_close"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", 2022): 1.0, ("a", 2023): 9.0, ("b", 2023): 3.0}


def test_normalized_bars(spark):
    raw = spark.createDataFrame([("a", dt.datetime(2024, 1, 2, 5), 1.0, 2.0, 0.5, 1.5, 10)], "asset string, Date timestamp_ntz, Open double, High double, Low double, Close double, Volume long")
    row = normalize_bars(raw).first()
    assert row["date"] == D(2024, 1, 2) and row["close"] == row["adj_close"] == 1.5
    with pytest.raises(ValueError, match="drifted"):
        normalize_bars(raw.withColumn("Dividends", F.lit(0)))


def test_panel_contract(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-1-2"), ("b", "2024-02-30"), ("b", None)], "asset string, date string")
    got = {(r["asset"], r["date_key"]): r["reason"] for r in ing.check_panel(df, ["asset"]).collect()}
    assert got == {("a", "2024-01-01"): "duplicate key", ("a", "2024-1-2"): "date key is not YYYY-MM-DD", ("b", "2024-02-30"): "date key is not YYYY-MM-DD", ("b", None): "date key is not YYYY-MM-DD"}
    with pytest.raises(ValueError, match="volume"):
        ing.check_panel(df, ["volume"])


def test_numeric_cleaning(spark):
    texts = [".", "", "  ", None, " 1.5 ", "NaN", "x", "-2e3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, value string")
    rows = ing.clean_numeric(df, "value").orderBy("i").collect()
    assert [r["value"] for r in rows] == [None, None, None, None, 1.5, None, None, -2000.0]
    assert [r["violation"] for r in rows] == [False] * 6 + [True, False]


def test_finite_audit(spark):
    df = spark.createDataFrame([("a", D(2024, 1, d), None if d % 2 else float("nan")) for d in range(1, 13)] + [("b", D(2024, 1, 1), 1.0)], P)
    row = ing.finite_audit(df, "adj_close").collect()
    assert len(row) == 1 and row[0]["n_bad"] == 12 and row[0]["first_keys"] == [f"2024-01-0{i}" for i in range(1, 6)]


def test_upsert(spark):
    target = bars(spark, ("a", 1, 1.0), ("a", 2, 2.0)).withColumn("volume", F.lit(7))
    out = frame(ing.upsert(target, bars(spark, ("a", 2, 5.0), ("b", 1, 6.0)), ["asset", "date"]), "asset", "date")
    assert out["adj_close"].tolist() == [1.0, 5.0, 6.0] and out["volume"].isna().tolist() == [False, False, True]
    wiped = ing.upsert(target, bars(spark, ("a", 2, None)), ["asset", "date"]).filter("adj_close IS NULL")
    assert wiped.count() == 1
    with pytest.raises(PySparkException, match="occurs twice"):
        ing.upsert(target, bars(spark, ("a", 2, 5.0), ("a", 2, 6.0)), ["asset", "date"]).collect()
    with pytest.raises(ValueError, match="key column"):
        ing.upsert(target, bars(spark, ("a", 2, 5.0)).drop("date"), ["asset", "date"])
    with pytest.raises(ValueError, match="unknown"):
        ing.upsert(target, bars(spark, ("a", 2, 5.0)).withColumn("z", F.lit(1)), ["asset", "date"])


def test_append(spark):
    target, universe = bars(spark, ("a", 1, 1.0)), spark.createDataFrame([("a",)], "asset string")
    assert ing.append(target, bars(spark, ("a", 2, 1.0)), universe).count() == 2
    with pytest.raises(PySparkException, match="q is not in the universe"):
        ing.append(target, bars(spark, ("q", 2, 1.0)), universe).collect()
    with pytest.raises(PySparkException, match="NaN in column adj_close"):
        ing.append(target, bars(spark, ("a", 2, float("nan"))), universe).collect()


def stored(spark):
    return bars(spark, *[("a", d, float(d)) for d in range(1, 21)], *[("b", d, float(d)) for d in range(1, 21)])


def test_overlap_rules(spark):
    fetched = bars(
        spark, ("a", 9, 999.0), ("a", 12, 12.0005), ("a", 13, 13.2), ("a", 20, 555.0), ("a", 21, 1.0), ("b", 12, 12.0), ("b", 15, None)
    )
    got = {(r["asset"], r["date"].day) for r in ing.overlap_mismatches(stored(spark), fetched).collect()}
    assert got == {("a", 13), ("b", 15)}
    both_missing = stored(spark).withColumn("adj_close", F.when(F.col("date") != D(2024, 1, 15), F.col("adj_close")))
    assert ing.overlap_mismatches(both_missing, bars(spark, ("b", 15, None))).count() == 0


def test_revision_merge(spark):
    full = bars(spark, *[("a", d, d * 0.7) for d in range(1, 23)], *[("b", d, float(d)) for d in range(1, 23)], *[("c", d, 1.0) for d in range(1, 4)])
    fetched = full.filter(F.col("date") >= D(2024, 1, 10))
    universe = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "asset string")
    merged, counts = ing.merge_prices(stored(spark), fetched, full, universe)
    got = {(r["asset"], r["date"].day): r["adj_close"] for r in merged.collect()}
    assert len(got) == 22 + 22 + 3 and got[("a", 1)] == pytest.approx(0.7) and got[("b", 1)] == 1.0
    assert {r["asset"]: (r["new_rows"], r["full_refresh"]) for r in counts.collect()} == {"a": (22, True), "b": (2, False), "c": (3, True), "d": (0, False)}


def test_changed_last_bar_heals_without_a_refresh(spark):
    fetched = bars(spark, *[("a", d, float(d)) for d in range(10, 20)], ("a", 20, 99.0), ("a", 21, 21.0))
    merged, counts = ing.merge_prices(stored(spark), fetched, fetched)
    assert {r["asset"]: r["new_rows"] for r in counts.collect()} == {"a": 1}
    assert merged.filter((F.col("asset") == "a") & (F.col("date") == D(2024, 1, 20))).first()["adj_close"] == 99.0


def test_macro_first_print_wins(spark):
    old = spark.createDataFrame([("s", D(2024, 1, 4), 1.0, D(2024, 1, 5))], "series_id string, obs_date date, value double, available_date date")
    new = spark.createDataFrame([("s", D(2024, 1, 4), "9"), ("s", D(2024, 1, 5), "2.5"), ("s", D(2024, 1, 6), "."), ("t", D(2024, 1, 1), "7")], "series_id string, obs_date date, value string")
    got = {(r["series_id"], r["obs_date"].day): (r["value"], str(r["available_date"])) for r in ing.append_macro(old, new, {"s": 1, "t": 3}).collect()}
    assert got == {("s", 4): (1.0, "2024-01-05"), ("s", 5): (2.5, "2024-01-08"), ("s", 6): (None, "2024-01-08"), ("t", 1): (7.0, "2024-01-04")}


def test_audit_needs_known_rules(spark):
    with pytest.raises(ValueError):
        ing.audit_tables({"t": bars(spark)}, [{"table": "t", "rule": "odd"}])
