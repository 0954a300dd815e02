"""Scalar expressions, all native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.defaults import CONFIDENCE_CEIL, CONFIDENCE_FLOOR, HORIZON_BARS, SIGMA_FLOOR, TRADING_DAYS

_ERF_TERMS = 30
_ERF_CAP = 1.5

# Wichura's published approximation of the normal quantile (AS 241, 1988), highest power first, for
# chances up to 0.425 from the middle and for the tail beyond.
_SPLIT, _CENTRE, _TAIL = 0.425, 0.180625, 1.6
NEAR_TOP = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
NEAR_BOTTOM = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
FAR_TOP = (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
FAR_BOTTOM = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)


def annualize_mean(mu_h: Column) -> Column:
    return mu_h * TRADING_DAYS / HORIZON_BARS


def annualize_vol(daily: Column) -> Column:
    return daily * math.sqrt(TRADING_DAYS)


def clamp(value: Column, low: float, high: float) -> Column:
    """Bounds with NaN kept out: Spark sorts NaN above every number."""
    return F.when(~F.isnan(value), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, NULL when a side is constant (the built-in stops the job there in ANSI mode)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def erf_capped(x: Column) -> Column:
    """``erf`` for ``x >= 0``, exact to double precision up to 1.5 and flat beyond.

    An all-positive series, so nothing cancels; the cap lies past the point where the confidence
    ceiling is reached.
    """
    x = F.least(x, F.lit(_ERF_CAP))
    total: Column = F.lit(0.0)
    square = x * x * 2.0
    for k in range(_ERF_TERMS, 0, -1):
        total = (total + 1.0) * square / float(2 * k + 1)
    return x * (2.0 / math.sqrt(math.pi)) * F.exp(-(x * x)) * (total + 1.0)


def confidence(mu: Column, sigma: Column) -> Column:
    """Chance mass of a normal within ``|mu/sigma|``, clamped. Takes the raw H-day pair, never annual figures."""
    return clamp(erf_capped(F.abs(mu / sigma) / math.sqrt(2.0)), CONFIDENCE_FLOOR, CONFIDENCE_CEIL)


def horizon_mean(annual: Column) -> Column:
    return annual * HORIZON_BARS / TRADING_DAYS


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    total: Column = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def two_sided_z(confidence: Column) -> Column:
    """The z within which a normal lies with the given chance, 0 to 0.9999; a rational approximation of full precision."""
    half = confidence / 2.0
    middle = F.lit(_CENTRE) - half * half
    near = half * _polynomial(middle, NEAR_TOP) / _polynomial(middle, NEAR_BOTTOM)
    tail = F.sqrt(-F.log(F.lit(0.5) - half)) - _TAIL
    far = _polynomial(tail, FAR_TOP) / _polynomial(tail, FAR_BOTTOM)
    return F.when(half <= _SPLIT, near).otherwise(far)


def horizon_sigma(mu_h: Column, stated_confidence: Column) -> Column:
    """The H-day deviation whose confidence map gives back ``stated_confidence``."""
    z = two_sided_z(clamp(stated_confidence, CONFIDENCE_FLOOR, CONFIDENCE_CEIL))
    return F.greatest(F.abs(mu_h) / z, F.lit(SIGMA_FLOOR))


def json_object(text: Column, schema: str) -> Column:
    """Tolerant parse: NULL, blank or corrupt text gives NULL."""
    return F.from_json(F.when(F.trim(text) != "", text), schema)


def json_error(text: Column) -> Column:
    """True when text is present but is not a JSON object."""
    return F.coalesce(F.trim(text) != "", F.lit(False)) & F.from_json(text, "map<string,string>").isNull()
