"""Scalar algebra of the selective-label model as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
DIRECTIONS = ("two-sided", "censored-lower", "censored-higher")


def as_col(x) -> Column:
    """A column from a column, a column name or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def r6(x, digits: int = 6) -> Column:
    """Round for publication; NaN becomes NULL and -0.0 becomes 0.0."""
    c = as_col(x).cast("double")
    return F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(as_col(x), as_col(lo)), as_col(hi))


def expit(z) -> Column:
    z = as_col(z)
    ez = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + ez)).otherwise(ez / (1.0 + ez))


def logit(p, eps: float = EPS) -> Column:
    p = clip(p, eps, 1.0 - eps)
    return F.log(p) - F.log1p(-p)


def at_least_one(x, name: str):
    """The number or column itself; a number below 1 is an error, a column value below 1 fails the job."""
    if isinstance(x, (int, float)):
        if not x >= 1.0:
            raise ValueError(f"{name} must be >= 1")
        return x
    x = as_col(x)
    return F.when(x < 1.0, F.raise_error(F.lit(f"{name} must be >= 1"))).otherwise(x)


def gamma_from_lambda(lam):
    """Square of Lambda, a number or a column."""
    lam = at_least_one(lam, "Lambda")
    return float(lam) ** 2 if isinstance(lam, (int, float)) else F.pow(lam, 2)


def lambda_from_gamma(gamma):
    """Root of Gamma, a number or a column."""
    gamma = at_least_one(gamma, "Gamma")
    return math.sqrt(gamma) if isinstance(gamma, (int, float)) else F.sqrt(gamma)


def tilt(p, gamma) -> Column:
    """Probability after multiplying its odds by ``gamma``."""
    p, g = as_col(p), as_col(gamma)
    return g * p / (1.0 + (g - 1.0) * p)


def tilt_slope(p, gamma) -> Column:
    p, g = as_col(p), as_col(gamma)
    return g / F.pow(1.0 + (g - 1.0) * p, 2)


def tilt_to_outcome(p1, e, a) -> Column:
    """Outcome probability when the censored odds are ``a`` times the selected."""
    p1, e, a = as_col(p1), as_col(e), as_col(a)
    return e * p1 + (1.0 - e) * expit(logit(p1) + F.log(F.greatest(a, F.lit(EPS))))


def box(p1, e, gamma, direction: str = "two-sided") -> tuple[Column, Column]:
    """Sharp pointwise bounds of P(Y=1|x); ``gamma`` is a number or a column.

    ``gamma = inf`` needs no special plan: the tilt limits are taken by ``when``.
    Inputs outside their domain raise inside the job.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    p1, e, g = checked_unit(p1, "p1"), checked_unit(e, "e"), as_col(at_least_one(gamma, "Gamma"))
    finite = g < F.lit(float("inf"))
    shift = F.log(F.when(finite, g).otherwise(F.lit(1.0)))
    eta = logit(p1)
    low = e * p1 + F.when(finite, (1.0 - e) * expit(eta - shift)).otherwise(F.lit(0.0))
    high = e * p1 + (1.0 - e) * F.when(finite, expit(eta + shift)).otherwise(F.lit(1.0))
    if direction == "censored-lower":
        high = p1
    elif direction == "censored-higher":
        low = p1
    return low, high


def checked_unit(x, name: str) -> Column:
    """The value itself, or a failed job when it lies outside [0, 1]."""
    x = as_col(x)
    return F.when((x < 0) | (x > 1), F.raise_error(F.lit(f"{name} must lie in [0, 1]"))).otherwise(x)


def log_odds_gap(p0, p1) -> Column:
    """Absolute difference of two log-odds."""
    return F.abs(logit(p0) - logit(p1))


def contains(value, lo, hi, tol: float = 1e-9) -> Column:
    v = as_col(value)
    return (v >= as_col(lo) - tol) & (v <= as_col(hi) + tol)


# --- losses -----------------------------------------------------------------

def softplus(z) -> Column:
    z = as_col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def _bounded_exp(z) -> Column:
    return F.exp(clip(z, -30.0, 30.0))


# name -> (loss at y=1, loss at y=0)
LOSSES = {
    "logistic": (lambda z: softplus(-z), softplus),
    "squared": (lambda z: F.pow(z - 1.0, 2), lambda z: F.pow(z, 2)),
    "exponential": (lambda z: _bounded_exp(-z), _bounded_exp),
    "hinge": (lambda z: F.greatest(F.lit(0.0), 1.0 - z), lambda z: F.greatest(F.lit(0.0), 1.0 + z)),
}


def loss_pair(score, loss="logistic") -> tuple[Column, Column]:
    """``(l(z, 1), l(z, 0))``; ``loss`` is a name or a pair of column functions."""
    if isinstance(loss, str):
        if loss not in LOSSES:
            raise KeyError(f"unknown loss {loss!r}; available: {sorted(LOSSES)}")
        loss = LOSSES[loss]
    z = as_col(score)
    return loss[0](z), loss[1](z)


def loss_at(score, p, loss="logistic") -> Column:
    """Expected loss of a score when the label is 1 with probability ``p``."""
    one, zero = loss_pair(score, loss)
    p = as_col(p)
    return p * one + (1.0 - p) * zero


def loss_gap(score, loss="logistic") -> Column:
    one, zero = loss_pair(score, loss)
    return F.abs(one - zero)


def worst_loss(score, lo, hi, loss="logistic") -> Column:
    return F.greatest(loss_at(score, hi, loss), loss_at(score, lo, loss))


def least_favourable_vertex(score, lo, hi, loss="logistic") -> Column:
    one, zero = loss_pair(score, loss)
    return F.when(one >= zero, as_col(hi)).otherwise(as_col(lo))


# --- entropy and Bayes acts -------------------------------------------------

def entropy(p) -> Column:
    """Binary entropy in nats."""
    p = clip(p, EPS, 1.0 - EPS)
    return -(p * F.log(p) + (1.0 - p) * F.log1p(-p))


def entropy_range(lo, hi) -> tuple[Column, Column]:
    """Smallest and largest entropy over [lo, hi]."""
    return F.least(entropy(lo), entropy(hi)), entropy(clip(F.lit(0.5), lo, hi))


def kl(p, q) -> Column:
    p, q = clip(p, EPS, 1.0 - EPS), as_col(q)
    return p * F.log(p / q) + (1.0 - p) * F.log((1.0 - p) / (1.0 - q))


def worst_regret(score, lo, hi) -> Column:
    """Largest KL(p || sigmoid(score)) over the box, in nats."""
    q = clip(expit(score), EPS, 1.0 - EPS)
    return F.greatest(kl(lo, q), kl(hi, q))


def bayes_score(lo, hi, criterion: str = "risk") -> Column:
    lo, hi = as_col(lo), as_col(hi)
    if criterion == "risk":
        return F.when(lo > 0.5, logit(lo)).when(hi < 0.5, logit(hi)).otherwise(F.lit(0.0))
    if criterion == "regret":
        width = hi - lo
        return F.when(width > 1e-9, (entropy(lo) - entropy(hi)) / width).otherwise(
            logit((lo + hi) * 0.5))
    raise ValueError("criterion must be 'risk' or 'regret'")


def abstains(lo, hi) -> Column:
    return (as_col(lo) <= 0.5) & (as_col(hi) >= 0.5)


# --- small-sample intervals -------------------------------------------------

def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    k, n = as_col(k).cast("double"), as_col(n).cast("double")
    p = k / n
    den = 1.0 + z * z / n
    mid = (p + z * z / (2.0 * n)) / den
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / den
    ok = n > 0
    return F.when(ok, mid - half), F.when(ok, mid + half)
