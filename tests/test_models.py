"""Fractional orders, the regression challenger and embedding checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelwright.functions.stationarity import adf_from_moments, default_max_lag, lag_design
from panelwright.operators import challenger
from panelwright.operators.challenger import ensemble_forecast, fit_moments, residual_variance, shuffled_control, solve_fits
from panelwright.operators.embeddings import collapse_metrics, collapse_verdict, regularity_scores
from panelwright.operators.fracdiff import ffd_weights, min_d_search
from panelwright.operators.windows import context_windows, purged_holdout, standardize


def test_weights():
    assert ffd_weights(0.0) == [1.0]
    assert ffd_weights(1.0) == [1.0, -1.0]
    w = ffd_weights(0.4, 1e-2)
    assert w[:3] == pytest.approx([1.0, -0.4, -0.12])
    assert all(x < 0 for x in w[1:]) and abs(w[-1]) >= 1e-2
    assert [len(ffd_weights(d)) for d in (0.10, 0.35, 0.5)] == [4076, 1826, 927]
    for d, thr in ((-0.1, 1e-5), (float("nan"), 1e-5), (0.5, 0.0)):
        with pytest.raises(ValueError):
            ffd_weights(d, thr)


def series(spark, **named):
    parts = [pd.DataFrame({"asset": k, "date": pd.date_range("2000-01-01", periods=len(v)).date, "log_price": v}) for k, v in named.items()]
    return spark.createDataFrame(pd.concat(parts), "asset string, date date, log_price double")


def anchors():
    noise = np.random.default_rng(0).normal(size=2000)
    walk = np.cumsum(np.random.default_rng(1).normal(size=2000))
    double = np.cumsum(np.cumsum(np.random.default_rng(5).normal(size=2000)))
    short = np.cumsum(np.random.default_rng(3).normal(size=90))
    return noise, walk, double, short


def test_smallest_stationary_order(spark):
    noise, walk, double, short = anchors()
    df = series(spark, noise=noise, walk=walk, double=double, short=short)
    good, report = min_d_search(df, on_invalid="quarantine")
    got = {r["asset"]: r for r in good.collect()}
    assert set(got) == {"noise", "walk"}
    assert got["noise"]["d"] == 0.0 and got["noise"]["corr"] == pytest.approx(1.0)
    assert got["walk"]["d"] >= 0.35 and got["walk"]["adf_pvalue"] < 0.05 and got["walk"]["window_len"] == 1826
    assert {r["asset"]: r["reason"] for r in report.collect()} == {"double": "no order reached stationarity", "short": "series too short for any order"}
    with pytest.raises(PySparkException, match="series too short"):
        min_d_search(series(spark, short=short)).collect()


def test_search_in_blocks(spark):
    noise, walk, _, _ = anchors()
    df = series(spark, noise=noise, walk=walk)
    a = min_d_search(df, (0.0, 0.5, 0.8), threshold=1e-3).toPandas().sort_values("asset")
    b = min_d_search(df, (0.0, 0.5, 0.8), threshold=1e-3, rows_per_block=500).toPandas().sort_values("asset")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), rtol=1e-6)


def test_unit_root_moments_against_least_squares():
    z = np.cumsum(np.random.default_rng(2).normal(size=400)) * 0.1
    lags = default_max_lag(len(z))
    design = lag_design(z, lags)

    def direct():
        best = None
        for p in range(lags + 1):
            x, y = design[:, [0, *range(1, p + 1), lags + 1]], design[:, -1]
            ssr = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
            aic = len(y) * np.log(ssr / len(y)) + 2 * x.shape[1]
            best = min(best or (aic, p), (aic, p))
        m = lag_design(z, best[1])
        x, y = m[:, :-1], m[:, -1]
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
        return beta[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])

    from panelwright.functions.stationarity import p_value

    assert adf_from_moments(design.T @ design, len(design), z[: lags + 1], lags) == pytest.approx(p_value(direct()), rel=1e-6)
    assert p_value(-2.86) == pytest.approx(0.05, abs=2e-3)


@pytest.fixture(scope="module")
def windows(spark):
    """Autoregressive returns, so the past does tell something about the future."""
    rng = np.random.default_rng(4)
    parts = []
    for k in range(4):
        x = np.zeros(700)
        for t in range(1, 700):
            x[t] = 0.9 * x[t - 1] + rng.normal() * 0.01
        parts.append(pd.DataFrame({"asset": f"a{k}", "date": pd.date_range("2010-01-01", periods=700).date, "log_return": x}))
    df = spark.createDataFrame(pd.concat(parts), "asset string, date date, log_return double")
    return purged_holdout(context_windows(df)).cache()


def test_holdout_is_purged(windows):
    r = windows.groupBy("asset", "role").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("k")).toPandas()
    for _, part in r.groupby("asset"):
        part = part.set_index("role")
        assert part.loc["train", "b"] + 21 < part.loc["holdout", "a"]
        assert part.loc["holdout", "k"] == round(0.25 * (700 - 15 - 21))


def test_scale_comes_from_training_rows_only(windows):
    scaled = standardize(windows, ("context",)).filter("role = 'train'").select(F.explode("context").alias("x"))
    row = scaled.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert row["m"] == pytest.approx(0.0, abs=1e-9) and row["s"] == pytest.approx(1.0, rel=1e-9)


def test_ridge_equals_spark_ml(windows):
    train = windows.filter("role = 'train'")
    mine = solve_fits(fit_moments(train, 16, {0: F.lit(True), 1: F.lit(True)}), 0.1, members=1).first()
    # Spark ML divides the penalty by the label's deviation.
    spread = train.agg(F.stddev_samp("realized_h")).first()[0]
    ml = LinearRegression(featuresCol="v", labelCol="realized_h", regParam=0.1 * spread, elasticNetParam=0.0, standardization=False, solver="normal").fit(
        standardize(windows, ("context",)).filter("role = 'train'").select(array_to_vector("context").alias("v"), "realized_h")
    )
    assert np.allclose(mine["weights"], ml.coefficients.toArray(), rtol=1e-3, atol=1e-6)
    assert mine["intercept"] == pytest.approx(ml.intercept, rel=1e-5, abs=1e-9)


def test_real_targets_beat_shuffled_ones(windows):
    row = shuffled_control(windows).first()
    assert row["real_mse"] < 0.8 * row["shuffled_mse"]


def test_control_makes_its_windows_once(spark, windows):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    n = windows.count()
    once = shuffled_control(windows.select("asset", "pos", "role", "context", "realized_h").mapInArrow(counted, "asset string, pos long, role string, context array<double>, realized_h double"))
    row = once.first()
    assert made.value == n
    assert tuple(row) == pytest.approx(tuple(shuffled_control(windows).first()), rel=1e-9)


@pytest.mark.parametrize("per_part, per_block", [(65_536, 256), (100, 7)])
def test_targets_are_paired_by_the_ranks_of_two_hashes(spark, windows, monkeypatch, per_part, per_block):
    monkeypatch.setattr(challenger, "ROWS_PER_PART", per_part)
    monkeypatch.setattr(challenger, "WINDOWS_PER_BLOCK", per_block)
    train = windows.filter("role = 'train' AND (asset <> 'a1' OR pos % 3 > 0)")
    hashes = [F.xxhash64("asset", "pos", F.lit(s)).alias(f"h{i}") for i, s in enumerate((5, 5 + 1_000_003))]
    plain = train.select("context", "realized_h", *hashes).toPandas()
    drawn = plain.sort_values("h1")["realized_h"].to_numpy()
    want = sorted((*c, y, d) for (c, y), d in zip(plain.sort_values("h0")[["context", "realized_h"]].itertuples(index=False), drawn, strict=True))
    got = sorted((*r["context"], r["realized_h"], r["_drawn"]) for r in challenger.shuffled_targets(train, seed=5).collect())
    assert got == want


def test_shuffled_targets_of_nothing(spark, windows):
    assert challenger.shuffled_targets(windows.filter("false")).count() == 0


def test_holdout_needs_no_second_pass_over_dates(spark, windows):
    plain = windows.drop("role").unionByName(windows.drop("role").limit(3).withColumn("asset", F.lit(None).cast("string")))
    one = purged_holdout(plain)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    got, want = (sorted(map(tuple, x.select("asset", "pos", "role").collect())) for x in (one, purged_holdout(plain.drop("date"))))
    assert got == want and {r[0] for r in got} == {"a0", "a1", "a2", "a3"}


def test_ensemble(spark):
    rows = [("a", i, "holdout", 0.1 * i, m, 0.05 * i + 0.01 * m) for i in range(5) for m in range(3)] + [("b", 1, "holdout", 0.2, 0, 0.1)]
    p = spark.createDataFrame(rows, "asset string, pos long, role string, realized_h double, member long, prediction double").withColumn("date", F.col("pos"))
    res = {r["asset"]: r["residual_var"] for r in residual_variance(p).collect()}
    e = np.array([0.1 * i - (0.05 * i + 0.01) for i in range(5)])
    assert res["a"] == pytest.approx(np.var(e, ddof=1))
    assert res["b"] == pytest.approx(np.var([*e, 0.1], ddof=1))
    out = {(r["asset"], r["date"]): r for r in ensemble_forecast(p, residual_variance(p)).collect()}
    assert out[("a", 2)]["sigma"] == pytest.approx(np.sqrt(res["a"] + 0.0001))
    assert out[("b", 1)]["sigma"] == pytest.approx(np.sqrt(res["b"]))


def test_embedding_metrics(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6)) * [1, 2, 3, 0.1, 0.5, 1.5] + 4
    line = np.outer(rng.normal(size=50), np.ones(6)) * 0.01
    rows = [("good", r.tolist()) for r in x] + [("flat", r.tolist()) for r in line]
    df = spark.createDataFrame(rows, "member string, v array<double>")
    got = {r["member"]: r for r in collapse_metrics(df, "v", ["member"]).collect()}
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert got["good"]["effective_rank"] == pytest.approx(values.sum() ** 2 / (values**2).sum(), rel=1e-9)
    assert got["good"]["std_median"] == pytest.approx(np.sort(x.std(axis=0, ddof=1))[2], rel=1e-9)
    assert got["flat"]["effective_rank"] == pytest.approx(1.0, rel=1e-6)
    assert not collapse_verdict(collapse_metrics(df, "v", ["member"])).first()["passed"]
    assert collapse_verdict(collapse_metrics(df.filter("member = 'good'"), "v")).first()["passed"]
    s = regularity_scores(df.filter("member = 'good'"), "v").first()
    c = np.cov(x.T)
    assert s["variance_term"] == pytest.approx(np.maximum(0, 1 - np.sqrt(x.var(axis=0) + 1e-4)).mean(), rel=1e-9)
    assert s["covariance_term"] == pytest.approx(((c - np.diag(np.diag(c))) ** 2).sum() / 6, rel=1e-9)


def test_fits_and_spectra_do_not_change_far_from_zero(spark):
    from panelwright.operators.challenger import fit_moments, solve_fits
    from panelwright.operators.embeddings import collapse_metrics, regularity_scores

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = x @ np.arange(6) + rng.normal(size=400)
    found = []
    for shift in (0.0, 2.0**20):
        rows = spark.createDataFrame([(i % 2, (v + shift).tolist(), float(t + shift)) for i, (v, t) in enumerate(zip(x, y))], "g long, context array<double>, realized_h double")
        fits = {0: F.lit(True), 1: F.col("g") == 0}
        (model,) = solve_fits(fit_moments(rows, 6, fits), 0.1, 1).collect()
        metrics = sorted(map(tuple, collapse_metrics(rows, "context", ["g"]).collect())) + sorted(map(tuple, regularity_scores(rows, "context").collect()))
        found.append((model, metrics))
    (a, near), (b, far) = found
    assert np.allclose(a.weights, b.weights, rtol=1e-8) and a.std == pytest.approx(b.std, rel=1e-8)
    assert a.mean + 2.0**20 == pytest.approx(b.mean, abs=1e-8) and a.intercept + 2.0**20 == pytest.approx(b.intercept, abs=1e-7)
    assert np.allclose(np.concatenate(near), np.concatenate(far), rtol=1e-8)


def test_one_transform_serves_all_orders_and_one_factor_all_lags():
    from panelwright.functions import stationarity as st
    from panelwright.operators.fracdiff import convolved

    rng, known = np.random.default_rng(3), {}
    kernels = {d: np.asarray(ffd_weights(d, 1e-4)) for d in (0.0, 0.05, 0.35, 0.8, 1.0)}
    for n in (1, 2, 90, 1000, 9000):
        x = np.cumsum(rng.normal(size=n)) * 0.01 + 7
        got = convolved(x, kernels, known)
        assert set(got) == {d for d, k in kernels.items() if len(k) <= n}
        assert all(np.abs(z - np.convolve(x, kernels[d], "valid")).max() < 1e-10 for d, z in got.items())
    z = np.cumsum(rng.normal(size=500))
    design = st.lag_design(z, 12)
    sums = st.nested_ssr(design.T @ design, 12)
    for p in range(13):
        used = design[:, [0, *range(1, p + 1), 13]]
        beta = np.linalg.lstsq(used, design[:, -1], rcond=None)[0]
        assert sums[p] == pytest.approx(((design[:, -1] - used @ beta) ** 2).sum(), rel=1e-9)
    flat = st.lag_design(np.ones(50), 2)
    assert st.nested_ssr(flat.T @ flat, 2) is None
