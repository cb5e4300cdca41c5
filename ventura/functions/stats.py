"""Interval and concentration statistics as Columns; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """95 % interval of a share, as shares; null for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Difference of two shares and its interval from the two Wilson intervals."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = F.try_divide(k1.cast("double"), n1.cast("double")), F.try_divide(k2.cast("double"), n2.cast("double"))
    d = p1 - p2
    return d, d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)), d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))


def odds_ratio(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Odds ratio with its interval; half is added to all cells if one is empty."""
    cells = [k1, n1 - k1, k2, n2 - k2]
    empty = (cells[0] == 0) | (cells[1] == 0) | (cells[2] == 0) | (cells[3] == 0)
    a, b, c, d = (x.cast("double") + F.when(empty, 0.5).otherwise(0.0) for x in cells)
    ratio, error = (a * d) / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return ratio, F.exp(F.log(ratio) - z * error), F.exp(F.log(ratio) + z * error)


def rogan_gladen(p: Column, sensitivity: Column, specificity: Column) -> Column:
    """Prevalence corrected for test error, clipped to 0..1; null if the test is no better than chance."""
    gain = sensitivity + specificity - 1
    return F.when(gain > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p + specificity - 1) / gain)))


def erf(x: Column) -> Column:
    """Error function by a rational approximation, absolute error under 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def two_proportion_p(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Pooled z and two-sided p value."""
    k1, n1, k2, n2 = (x.cast("double") for x in (k1, n1, k2, n2))
    pooled = (k1 + k2) / (n1 + n2)
    z = (k1 / n1 - k2 / n2) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return z, 1 - erf(F.abs(z) / F.sqrt(F.lit(2.0)))


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    tp, fp, fn = (x.cast("double") for x in (tp, fp, fn))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.try_divide(2 * p * r, p + r)


def hhi(share: Column) -> Column:
    """Sum of squared shares."""
    return F.sum(share * share)


def entropy(share: Column) -> Column:
    """Shannon entropy in nats over positive shares."""
    return -F.sum(F.when(share > 0, share * F.log(share)).otherwise(0.0))
