"""Rounding with the results of the source system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two decimals of the exact binary value, ties to even (0.575 -> 0.57, 0.125 -> 0.12).

    ``round`` and ``bround`` work on the shortest decimal text instead and differ on values
    such as 0.575. Here the fraction is scaled to a whole number without loss and compared with
    the midpoint between the two candidates. Exact for every x >= 0; from 2**52 on there is no fraction.
    """
    whole = F.floor(x)
    part = x - whole
    low = F.floor(part * 100)
    scale = F.when(part < 0.25, F.lit(2**60)).otherwise(F.lit(2**54))
    value = (part * scale).cast("bigint").cast("decimal(19,0)") * F.lit(200).cast("decimal(3,0)")
    middle = (low * 2 + 1).cast("decimal(6,0)") * scale.cast("decimal(19,0)")
    up = (value > middle) | ((value == middle) & (F.pmod(low, F.lit(2)) == 1))
    return F.when(x < 2**52, (whole * 100 + low + up.cast("int")) / 100.0).otherwise(x)
