"""Exact rating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rating_of(total: Column, count: Column) -> Column:
    """Mean rating with one decimal from an integer sum and count.

    The mean is first rounded half-up to hundredths and the result half-up to
    tenths (17/11 = 1.545... -> 1.55 -> 1.6), all in integers; no rows give 0.0.
    """
    n, s = count.cast("bigint"), total.cast("bigint")
    doubled = s * 200 + n
    # floor(doubled / 2n) without leaving the integers; the division is exact.
    hundredths = ((doubled - F.pmod(doubled, n * 2)) / (n * 2)).cast("bigint")
    bumped = hundredths + 5
    tenths = ((bumped - F.pmod(bumped, F.lit(10))) / 10).cast("decimal(10,0)")
    value = (tenths / F.lit(10).cast("decimal(10,0)")).cast("decimal(2,1)")
    return F.when(n > 0, value).otherwise(F.lit(0).cast("decimal(2,1)"))
