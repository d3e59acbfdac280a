"""Generalised-logistic distribution by L-moments, and the normal quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

# Rational approximation of the normal quantile (P. J. Acklam)
PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
PPF_LOW = 0.02425


def _poly(coeffs, x: Column) -> Column:
    """Horner evaluation, highest power first."""
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    def tail(prob: Column) -> Column:
        q = F.sqrt(-2.0 * F.log(prob))
        return _poly(PPF_C, q) / _poly([*PPF_D, 1.0], q)

    centred = p - 0.5
    r = centred * centred
    middle = _poly(PPF_A, r) * centred / _poly([*PPF_B, 1.0], r)
    return F.when(p < PPF_LOW, tail(p)).when(p > 1.0 - PPF_LOW, -tail(1.0 - p)).otherwise(middle)


def sigmoid(z: Column) -> Column:
    """1/(1+exp(-z)) without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def glo_cdf(x: Column, xi: Column, alpha: Column, kappa: Column, support: float = 0.0) -> Column:
    """Distribution function; outside the support 0 for kappa<0, else 1."""
    y = (x - xi) / alpha
    arg = 1.0 - kappa * y
    return (
        F.when(F.abs(kappa) < 1e-12, sigmoid(y))
        .when(arg > support, sigmoid(-F.log(arg) / kappa))
        .otherwise(F.when(kappa < 0, 0.0).otherwise(1.0))
    )


def pwm(rank0: Column, x: Column, n: Column) -> tuple[Column, Column, Column]:
    """Summands of the unbiased weighted moments b0, b1, b2 (sum them per group).

    ``rank0`` is the zero-based rank of x, ``n`` the group size; b1 and b2 need
    three values.
    """
    enough = n >= 3
    b0 = x / n
    b1 = F.when(enough, x * rank0 / (n * (n - 1)))
    b2 = F.when(enough, x * rank0 * (rank0 - 1) / (n * (n - 1) * (n - 2)))
    return b0, b1, b2


def lmoments(b0: Column, b1: Column, b2: Column) -> tuple[Column, Column, Column]:
    return b0, 2.0 * b1 - b0, 6.0 * b2 - 6.0 * b1 + b0


def glo_params(lam1: Column, lam2: Column, tau3: Column) -> dict[str, Column]:
    """xi, alpha, kappa; all null where no valid fit exists."""
    kappa = -tau3
    s = F.sin(F.lit(math.pi) * kappa)
    usable = (lam2 > 0) & (F.abs(kappa) < 1.0)
    logistic = F.abs(kappa) < 1e-6
    alpha = F.when(logistic, lam2).otherwise(lam2 * s / (F.lit(math.pi) * kappa))
    xi = F.when(logistic, lam1).otherwise(lam1 - alpha * (1.0 / kappa - F.lit(math.pi) / s))
    ok = usable & (logistic | (F.abs(s) >= 1e-12)) & (alpha > 0)
    return {
        "xi": F.when(ok, xi),
        "alpha": F.when(ok, alpha),
        "kappa": F.when(ok, F.when(logistic, 0.0).otherwise(kappa)),
    }
