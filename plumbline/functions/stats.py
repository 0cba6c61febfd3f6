"""Statistics as native column expressions (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import CLIP

_SQRT_PI = math.sqrt(math.pi)

def psi_term(reference: Column, current: Column) -> Column:
    """One bin's share of the population stability index."""
    ref = F.least(F.greatest(reference, F.lit(CLIP)), F.lit(1.0))
    cur = F.least(F.greatest(current, F.lit(CLIP)), F.lit(1.0))
    return (cur - ref) * F.ln(cur / ref)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0."""
    square = z * z
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term")),
        lambda acc, k: F.struct(
            (acc["total"] + acc["term"] * 2 * square / (2 * k + 1)).alias("total"),
            (acc["term"] * 2 * square / (2 * k + 1)).alias("term"),
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1)),
        F.lit(0.0),
        lambda acc, k: (k / 2) / (z + acc),
    )
    near = 1 - (2 / _SQRT_PI) * F.exp(-square) * z * series
    far = F.exp(-square) / _SQRT_PI / (z + fraction)
    return F.when(z < 2, near).otherwise(far)


#: Steps by which the argument of the gamma function is raised before its asymptotic series.
_RAISED = 10
#: Coefficients 1/12, -1/360, ... of that series.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def _log1p_less(m: Column) -> Column:
    """m - ln(1 + m), also where m is small."""
    return m - F.log1p(m)


def _log_density(a: Column, x: Column) -> Column:
    """Logarithm of x^a e^-x / Gamma(a), without the large terms that would cancel each other."""
    b = a + _RAISED
    raised = F.lit(0.0)
    for k in range(_RAISED):
        raised = raised + F.ln((a + k) / x)
    series = F.lit(0.0)
    for i, c in enumerate(_STIRLING):
        series = series + c / F.pow(b, F.lit(2.0 * i + 1))
    return raised + 0.5 * F.ln(b / (2 * math.pi)) - b * _log1p_less((x - b) / b) - series


def chi2_sf(statistic: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution; null when df is 0.

    The regularised incomplete gamma function of df / 2 and statistic / 2, by
    its power series below the mean and by its continued fraction above. Both
    take a number of terms that depends on df alone and is enough wherever the
    statistic lies.
    """
    a, x = df.cast("double") / 2, statistic.cast("double") / 2
    terms = F.lit(80) + F.ceil(9 * F.sqrt(a)).cast("int")
    steps = F.sequence(F.lit(1), terms)
    below = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term")),
        lambda acc, k: F.struct((acc["total"] + acc["term"] * x / (a + k)).alias("total"), (acc["term"] * x / (a + k)).alias("term")),
        lambda acc: acc["total"] / a,
    )
    # From the last step to the first: x + 2k - 1 - a + k (a - k) / (what is behind).
    behind = x + 2 * terms + 1 - a
    above = F.aggregate(F.reverse(steps), behind, lambda acc, k: x + (2 * k - 1) - a + k * (a - k) / acc, lambda acc: 1 / acc)
    density = F.exp(_log_density(a, x))
    tail = F.when(x < a + 1, 1 - density * below).otherwise(density * above)
    return (
        F.when(df < 1, F.lit(None).cast("double"))
        .when(statistic <= 0, F.lit(1.0))
        .otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))
    )


def adjusted_skewness(value: Column) -> Column:
    """Bias-adjusted sample skewness; null below three rows."""
    n = F.count(value)
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n >= 3, F.skewness(value) * factor)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, with 0.0 on a zero bottom."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def f1_score(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)
