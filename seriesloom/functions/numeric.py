"""Column arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1: splits a double into two exactly multipliable halves


def exact_round(x: Column, digits: int) -> Column:
    """Round half-to-even on the exact binary value, which is what ``printf`` prints.

    ``round`` and ``bround`` decide ties on the shortest decimal text of a double
    (12.35 looks like a tie there, but is stored just below it). The product with
    the power of ten is split into a value and its exact rounding error, so ties
    are seen only where they really exist. Plain double arithmetic, code-generated.
    """
    scale = float(10**digits)
    x = x.cast("double")
    big = x * F.lit(_SPLIT)
    head = big - (big - x)
    tail = x - head
    product = x * F.lit(scale)
    error = (head * F.lit(scale) - product) + tail * F.lit(scale)
    base = F.floor(product)
    over = (product - base) + error
    up = (over > 0.5) | ((over == 0.5) & (F.pmod(base, F.lit(2)) == 1))
    rounded = (base + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("double") / F.lit(scale)
    # Beyond 2**52 a double has no fraction left, and floor would leave BIGINT.
    return F.when(F.abs(product) < 4.5e15, rounded).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in doubles, NULL where ``b`` is zero (ANSI mode raises otherwise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skew from the population skew; 0 for a constant, NULL below 3 rows."""
    n = n.cast("double")
    return F.when(n >= 3, F.coalesce(g1, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant, NULL below 4 rows."""
    n = n.cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))
