import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import walk_frame
from pyspark.sql import functions as F

from panelwright.operators.ewma import latest_forecast
from panelwright.operators.returns import log_returns
from panelwright.streaming import ewma_state, price_ingest
from panelwright.streaming.bars import tick_bars

PRICES = "asset string, date date, adj_close double"


def test_stream_bars_equal_batch_bars_and_drop_late_ticks(spark, tmp_path):
    rng = np.random.default_rng(0)
    stamps = pd.date_range("2024-01-01", periods=600, freq="37s")
    ticks = pd.DataFrame({"event_type": np.where(np.arange(600) % 3 == 0, "a", "b"), "ts": stamps, "value": rng.normal(size=600)})
    late = pd.DataFrame({"event_type": ["a"], "ts": [pd.Timestamp("2024-01-01 00:10:00")], "value": [99.0]})
    end = pd.DataFrame({"event_type": ["a"], "ts": [pd.Timestamp("2024-01-02")], "value": [0.0]})
    source, schema = str(tmp_path / "in"), "event_type string, ts timestamp, value double"
    spark.createDataFrame(ticks.iloc[:0], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = tick_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in (ticks, end, late, end.assign(ts=end["ts"] + pd.Timedelta(days=1))):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("bars_out").toPandas().sort_values(["asset", "bar_start"])
    got = got[got["bar_start"] < "2024-01-01 08:00"].reset_index(drop=True)
    want = tick_bars(spark.createDataFrame(ticks, schema)).toPandas().sort_values(["asset", "bar_start"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_state_equals_batch(spark):
    pdf = walk_frame(days=120)
    days = sorted(set(pdf["date"]))
    state = ewma_state.empty_state(spark)
    for lo, hi in ((0, 1), (1, 50), (50, 51), (51, 120)):
        batch = spark.createDataFrame(pdf[pdf["date"].isin(days[lo:hi])], PRICES)
        state, late = ewma_state.advance(state, batch, rows_per_block=16)
        assert late.count() == 0
        state = spark.createDataFrame(state.toPandas(), ewma_state.STATE_SCHEMA)
    got = {r["asset"]: (r["mu"], r["n"]) for r in ewma_state.state_forecast(state).collect()}
    want = {r["asset"]: (r["mu"], r["n_bars"]) for r in latest_forecast(log_returns(spark.createDataFrame(pdf, PRICES))).collect()}
    for asset, (mu, n) in want.items():
        assert got[asset][0] == pytest.approx(mu, rel=1e-11) and got[asset][1] == n
    revised = spark.createDataFrame(pdf[(pdf["date"] == days[60]) & (pdf["asset"] == "SPY")], PRICES)
    after, late = ewma_state.advance(state, revised)
    assert [r["asset"] for r in late.collect()] == ["SPY"]
    assert {r["asset"]: r["n"] for r in after.collect()} == {a: 119 for a in want}


def test_replayed_batch_gives_the_same_state(spark, tmp_path):
    pdf = walk_frame(days=60)
    days = sorted(set(pdf["date"]))
    run = ewma_state.foreach_batch(str(tmp_path / "state"))
    cut = lambda lo, hi: spark.createDataFrame(pdf[pdf["date"].isin(days[lo:hi])], PRICES)
    run(cut(0, 30), 0)
    run(cut(30, 60), 1)
    once = spark.read.parquet(str(tmp_path / "state/batch=1")).toPandas().sort_values("asset").reset_index(drop=True)
    run(cut(30, 60), 1)
    again = spark.read.parquet(str(tmp_path / "state/batch=1")).toPandas().sort_values("asset").reset_index(drop=True)
    pd.testing.assert_frame_equal(once, again)


def test_stateful_operator_equals_batch(spark, tmp_path):
    pdf = log_returns(spark.createDataFrame(walk_frame(days=90), PRICES)).toPandas()
    schema = "asset string, date date, log_return double"
    source = str(tmp_path / "in")
    days = sorted(set(pdf["date"]))
    old = pdf[(pdf["date"] == days[3]) & (pdf["asset"] == "AGG")]
    spark.createDataFrame(pdf.iloc[:0], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = ewma_state.stateful_forecast(stream).writeStream.format("memory").queryName("mu_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in (pdf[pdf["date"] <= days[40]], pdf[pdf["date"] > days[40]], old):
            # One file a batch: several would become visible one after the other.
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    out = spark.table("mu_out").toPandas()
    assert out[out["status"] == "recompute"]["asset"].tolist() == ["AGG"]
    for asset, part in pdf.groupby("asset"):
        want = part.sort_values("date")["log_return"].ewm(halflife=63).mean() * 21
        got = out[(out["asset"] == asset) & (out["status"] == "ok")].sort_values("date")["mu"]
        assert np.allclose(got, want, rtol=1e-11)


def test_price_ingest_upserts_refreshes_and_gates(spark, tmp_path):
    schema = PRICES + ", fetched_at timestamp"
    at = lambda n: dt.datetime(2024, 2, 1, n)
    row = lambda a, d, p, n: (a, dt.date(2024, 1, d), p, at(n))
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    history = frame(*[row("a", d, d * 0.7, 3) for d in range(1, 17)])
    moved = {}

    def full(keys):
        return history.join(keys, "asset", "left_semi")

    path, source = str(tmp_path / "panel"), str(tmp_path / "in")
    handler = price_ingest.foreach_batch(path, full, lambda keys, b: moved.__setitem__(b, sorted(r["asset"] for r in keys.collect())))
    batches = [
        frame(*[row("a", d, float(d), 1) for d in range(1, 16)], *[row("b", d, float(d), 1) for d in range(1, 16)]),
        frame(row("b", 15, 15.5, 2), row("b", 16, 16.0, 2)),
        frame(row("a", 12, 12 * 0.7, 3), row("a", 16, 16 * 0.7, 3)),
    ]
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = price_ingest.start(stream, handler, str(tmp_path / "c"), always_on=False)
        query.awaitTermination(60)
        assert query.exception() is None
    assert moved == {0: ["a", "b"], 1: ["b"], 2: ["a"]}
    got = {(r["asset"], r["date"].day): r["adj_close"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 32 and got[("b", 15)] == 15.5 and got[("a", 1)] == pytest.approx(0.7) and got[("a", 16)] == pytest.approx(11.2)
    handler(batches[2], 2)
    assert {(r["asset"], r["date"].day): r["adj_close"] for r in spark.read.parquet(path).collect()} == got


def test_unions_keep_keys_together(spark):
    """A union below a window must not inherit a partitioning that adaptive execution has changed."""
    from panelwright.session import UNION_CONF, unite

    spark.conf.set(UNION_CONF, "true")
    a = spark.range(200).select((F.col("id") % 50).cast("string").alias("asset"), F.lit(1).alias("x"))
    unite(a, a)
    assert spark.conf.get(UNION_CONF) == "false"


def test_faded_sums_follow_the_recurrence():
    from panelwright.streaming.ewma_state import faded_sums

    x = np.random.default_rng(1).normal(size=2500)
    for halflife in (0.001, 0.5, 1.7, 63.0):
        fade, s, want = 0.5 ** (1 / halflife), 0.3, []
        for v in x:
            s = s * fade + v
            want.append(s)
        assert np.allclose(faded_sums(x, halflife, 0.3), want, rtol=1e-9)


def test_stateful_forecast_does_not_depend_on_chunks(spark, tmp_path):
    pdf = log_returns(spark.createDataFrame(walk_frame(days=60), PRICES)).toPandas()
    mixed = pdf.sample(frac=1.0, random_state=4)
    seen = []
    for size in (3, 10_000):
        spark.createDataFrame(mixed, "asset string, date date, log_return double").coalesce(1).write.parquet(f"{tmp_path}/in{size}")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            stream = spark.readStream.schema("asset string, date date, log_return double").parquet(f"{tmp_path}/in{size}")
            run = ewma_state.stateful_forecast(stream).writeStream.format("memory").queryName(f"chunks{size}").option("checkpointLocation", f"{tmp_path}/c{size}").trigger(availableNow=True).start()
            run.awaitTermination(120)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        seen.append(sorted((r["asset"], str(r["date"]), r["n"], r["mu"], r["status"]) for r in spark.table(f"chunks{size}").collect()))
    assert seen[0] == seen[1] and {r[4] for r in seen[0]} == {"ok"}


def test_recompute_reads_a_store_that_holds_the_batch(spark, tmp_path):
    found = []
    handler = price_ingest.foreach_batch(str(tmp_path / "p"), recompute=lambda keys, b: found.append((b, keys.count(), spark.read.parquet(str(tmp_path / "p")).count())))
    rows = spark.createDataFrame(walk_frame(days=5), PRICES).withColumn("fetched_at", F.lit("2026-02-01 00:00:00").cast("timestamp_ntz"))
    first = rows.filter("date < '2024-01-04'")
    handler(first, 0)
    handler(rows, 1)
    assert found == [(0, 3, first.count()), (1, 3, rows.count())]
