"""Black-Litterman blending for many (portfolio, scenario) groups at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import RISK_AVERSION, TAU
from panelwright.functions.scalars import annualize_mean, confidence
from panelwright.operators.layout import fresh

_SUM_TOLERANCE = 1e-6


def equilibrium_prior(cov: DataFrame, weights: DataFrame, delta: float = RISK_AVERSION, by: list[str] | None = None, rf: float = 0.0) -> DataFrame:
    """``delta * cov * w`` per asset. Weights must cover the matrix and sum to one; rf must be zero."""
    if rf != 0.0:
        raise ValueError("rf must be 0: the prior and the views are both excess returns")
    if not delta > 0:
        raise ValueError(f"delta must be positive, got {delta!r}")
    by = by or []
    weight_by = [b for b in by if b in weights.columns]
    w = weights.select(*weight_by, F.col("asset").alias("asset_j"), F.col("weight").alias("_w"))
    summed = cov.join(w, [*weight_by, "asset_j"], "left").groupBy(*by, "asset_i").agg(
        F.sum(F.col("cov") * F.col("_w")).alias("_p"),
        F.sum("_w").alias("_total"),
        F.count(F.when(F.col("_w").isNull(), 1)).alias("_missing"),
    )
    prior = F.when(
        (F.col("_missing") > 0) | ~(F.abs(F.col("_total") - 1.0) <= _SUM_TOLERANCE),
        contracts.fail("benchmark weights must cover every asset and sum to 1: sum ", F.col("_total"), ", missing ", F.col("_missing")),
    ).otherwise(F.col("_p") * delta)
    return summed.select(*by, F.col("asset_i").alias("asset"), prior.alias("prior_mu"))


def view_terms(views: DataFrame, cov: DataFrame, by: list[str], tau: float = TAU) -> DataFrame:
    """Annual view, confidence from the raw H-day pair, and the view's error variance."""
    if not 0.0 < tau <= 1.0:
        raise ValueError(f"tau must be in (0, 1], got {tau!r}")
    cov_by = [b for b in by if b in cov.columns]
    diagonal = cov.filter(F.col("asset_i") == F.col("asset_j")).select(*cov_by, F.col("asset_i").alias("asset"), F.col("cov").alias("_var"))
    c = F.col("view_confidence")
    return (
        views.join(diagonal, [*cov_by, "asset"])
        .withColumn("view_mu", annualize_mean(F.col("mu")))
        .withColumn("view_confidence", confidence(F.col("mu"), F.col("sigma")))
        .withColumn("omega", F.lit(tau) * (F.lit(1.0) - c) / c * F.col("_var"))
        .select(*by, "asset", "view_mu", "view_confidence", "omega")
    )


def blended(s: np.ndarray, pi: np.ndarray, view_mu: np.ndarray, omega: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and matrix of one portfolio; an asset without a view has no ``omega``."""
    seen = ~np.isnan(omega)
    m, spread = pi.copy(), tau * s
    if seen.any():
        gain = np.linalg.solve(tau * s[np.ix_(seen, seen)] + np.diag(omega[seen]), tau * s[seen, :])
        m = pi + gain.T @ (view_mu[seen] - pi[seen])
        spread = tau * s - tau * s[:, seen] @ gain
    return m, s + (spread + spread.T) / 2


def posterior(cov: DataFrame, prior: DataFrame, terms: DataFrame, by: list[str], tau: float = TAU) -> DataFrame:
    """``(by, asset_i, asset_j, cov, mu)`` per group; ``mu`` is set on the diagonal.

    Any subset of assets may carry a view; a group without views keeps the prior and inflates the
    matrix. One group is one matrix, so its size is set by the portfolio, not by the history.
    """
    inputs = prior.join(terms, [*by, "asset"], "left").select(*by, "asset", "prior_mu", "view_mu", "omega")
    types = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def blend(matrix: pd.DataFrame, assets: pd.DataFrame) -> pd.DataFrame:
        if matrix.empty or assets.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*by, "asset_i", "asset_j", "cov", "mu"]})
        wide = matrix.pivot(index="asset_i", columns="asset_j", values="cov")
        names = wide.index.to_numpy()
        s = wide.loc[names, names].to_numpy(float)
        s = (s + s.T) / 2
        lines = assets.set_index("asset").loc[names]
        pi = lines["prior_mu"].to_numpy(float)
        m, total = blended(s, pi, lines["view_mu"].to_numpy(float), lines["omega"].to_numpy(float), tau)
        i, j = np.meshgrid(names, names, indexing="ij")
        mu = np.full(total.shape, np.nan)
        np.fill_diagonal(mu, m)
        frame = pd.DataFrame({"asset_i": i.ravel(), "asset_j": j.ravel(), "cov": total.ravel(), "mu": mu.ravel()})
        for b in by:
            frame[b] = matrix[b].iloc[0]
        return frame[[*by, "asset_i", "asset_j", "cov", "mu"]]

    schema = ", ".join(f"{b} {types[b]}" for b in by) + f", asset_i {types['asset_i']}, asset_j {types['asset_j']}, cov double, mu double"
    out = fresh(cov).groupBy(*by).cogroup(fresh(inputs).groupBy(*by)).applyInPandas(blend, schema)
    return out.withColumn("mu", F.nanvl("mu", F.lit(None).cast("double")))


def posterior_report(post: DataFrame, prior: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """Per asset: prior, view, posterior, its deviation and the tilt. View columns are NULL where there is no view."""
    own = post.filter(F.col("asset_i") == F.col("asset_j")).select(
        *by, F.col("asset_i").alias("asset"), F.col("mu").alias("posterior_mu"), F.sqrt("cov").alias("posterior_sigma")
    )
    return (
        own.join(prior, [*by, "asset"])
        .join(terms, [*by, "asset"], "left")
        .select(
            *by,
            "asset",
            "prior_mu",
            "view_mu",
            "view_confidence",
            "omega",
            "posterior_mu",
            "posterior_sigma",
            (F.col("posterior_mu") - F.col("prior_mu")).alias("tilt"),
        )
    )
