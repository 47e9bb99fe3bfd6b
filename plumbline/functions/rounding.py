"""Rounding as SQL engines that compute in doubles do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """A double at so many decimals, half away from zero, by its product with the power of ten.  `F.round` goes by the shortest
    decimal text, and differs where that ends in a 5 which the double lies below."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    up = F.abs(v) * F.lit(10.0**digits)
    whole = F.floor(up).cast("double")
    exact = F.when(up < 2.0**52, whole + F.when(up - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(up)
    return F.when(F.isnan(v) | (up == float("inf")), v).otherwise(F.signum(v) * (exact / F.lit(10.0**digits)))
