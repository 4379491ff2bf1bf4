"""Signed logarithmic buckets of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Bucket of the infinite values; it lies beyond all others.
FAR = 1 << 62


def bucket(v: Column, width: float) -> Column:
    """Ordinal of the bucket of a value, to a relative width; ordinals are in the order of the values. Zero and the infinite
    values have buckets of their own. Not for null and NaN."""
    scale = 1.0 / math.log1p(width)
    shift = math.ceil(-math.log(5e-324) * scale) + 1
    size = F.when(F.abs(v) == float("inf"), F.lit(FAR)).otherwise((F.floor(F.log(F.abs(v)) * F.lit(scale)) + F.lit(shift)).cast("bigint"))
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")
