"""Statistical functions as SQL expressions, and as columns.

The SQL texts use only operators that every engine has, so the same definition can
be evaluated by Spark and checked elsewhere. None of them divides by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz & Stegun 7.1.26 polynomial.
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_P = 0.3275911


def erf_sql(x: str) -> str:
    t = f"(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST({_P} AS DOUBLE) * abs({x})))"
    poly = f"CAST({_A[4]} AS DOUBLE)"
    for a in reversed(_A[:4]):
        poly = f"({poly} * {t} + CAST({a} AS DOUBLE))"
    return f"(sign({x}) * (CAST(1 AS DOUBLE) - {poly} * {t} * exp(-({x}) * ({x}))))"


def norm_cdf_sql(z: str) -> str:
    return f"(CAST(0.5 AS DOUBLE) * (CAST(1 AS DOUBLE) + {erf_sql(f'(({z}) / sqrt(CAST(2 AS DOUBLE)))')}))"


def two_tailed_sql(z: str) -> str:
    """2 (1 - Phi(z)) for z >= 0."""
    return f"(CAST(2 AS DOUBLE) * (CAST(1 AS DOUBLE) - {norm_cdf_sql(z)}))"


def t_test_p_sql(t: str, df: str) -> str:
    """Two-tailed p of Student's t (t >= 0), by a normal approximation."""
    z = f"(({t}) * (1 - 1 / (4 * CAST({df} AS DOUBLE))) / sqrt(1 + ({t}) * ({t}) / (2 * CAST({df} AS DOUBLE))))"
    return f"(CASE WHEN {df} <= 0 THEN CAST(1 AS DOUBLE) WHEN {df} > 30 THEN {two_tailed_sql(t)} ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {two_tailed_sql(z)})) END)"


def fisher_p_sql(r: str, n: str) -> str:
    """Significance of a correlation; 0 for a perfect one."""
    z = f"abs(CAST(0.5 AS DOUBLE) * ln((1 + {r}) / (1 - {r})) * sqrt(CAST({n} - 3 AS DOUBLE)))"
    return f"(CASE WHEN abs({r}) >= 1 THEN CAST(0 AS DOUBLE) ELSE {two_tailed_sql(z)} END)"


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves up, also below zero."""
    power = float(10**digits)
    return F.floor(value * power + 0.5) / power


def t_test_p(t: str, df: str) -> Column:
    return F.expr(t_test_p_sql(t, df))


def finite(column: str) -> Column:
    """Neither null nor NaN nor infinite (NaN sorts above every number)."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
