"""Scalar formulas over columns; division by zero gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest probability that enters a logarithm, and the step added where the formulas add one.
TINY = 1e-15
EPS = 2.220446049250313e-16


def entropy_term(p: Column) -> Column:
    """-p ln p, with p no smaller than TINY."""
    safe = F.greatest(p.cast("double"), F.lit(TINY))
    return -safe * F.ln(safe)


def binary_entropy(ones: Column, n: Column) -> Column:
    """Entropy of a 0/1 column with ``ones`` ones of ``n``; a value that doesn't occur adds nothing."""
    p, q = F.try_divide(ones, n), F.try_divide(n - ones, n)
    return F.when(ones > 0, entropy_term(p)).otherwise(0.0) + F.when(ones < n, entropy_term(q)).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_logistic(margin: Column, negative: bool = True) -> Column:
    """ln(1 + e^x) of the margin, negated if ``negative``; the margin isn't clipped."""
    stable = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return -stable if negative else stable


#: Ten times the logarithms of the smallest and the largest double.
EXPONENTS = 10 * math.log(2.2250738585072014e-308), 10 * math.log(1.7976931348623157e308)


def clip_exponent(x: Column) -> Column:
    return F.greatest(F.lit(EXPONENTS[0]), F.least(F.lit(EXPONENTS[1]), x))


def rescaled(x: Column, low: Column, high: Column) -> Column:
    """``x`` from low..high to -1..1, as a square matrix of exponents is brought into bounds; null where low is high."""
    return F.try_divide(2 * (x - low), high - low) - 1


def softmax_over(x: Column, window) -> Column:
    """Softmax of ``x`` within the window's partition, from the largest down."""
    e = F.exp(x - F.max(x).over(window))
    return e / F.sum(e).over(window)


def optimal_step(alpha: float) -> float:
    """The offset of the learning rate 1 / (alpha (offset + epoch - 1))."""
    typical = math.sqrt(1 / math.sqrt(alpha))
    first = typical / max(1.0, math.log1p(math.exp(typical)))
    return 1 / (first * alpha)


def chi_square(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Chi-square of the two-row table of two labels over instances, zeros taken as 0.01.

    Instances with the same pair of values add the same, so four counts are enough.
    """
    low = 0.01
    counts = {(1.0, 1.0): n11, (1.0, low): n10, (low, 1.0): n01, (low, low): n00}
    rows = [sum((c * p[k] for p, c in counts.items()), F.lit(0.0)) for k in (0, 1)]
    total = rows[0] + rows[1]
    found = F.lit(0.0)
    for values, count in counts.items():
        column = values[0] + values[1]
        for value, row in zip(values, rows, strict=True):
            expected = row * column / total
            found = found + count * F.pow(F.lit(value) - expected, 2) / expected
    return found
