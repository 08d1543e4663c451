"""Money as binary fractions: rounding of what a double holds, not of how it prints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planwatch.functions.text import let

_SPLIT = float((1 << 27) + 1)


def rounded(x: Column, digits: int = 2) -> Column:
    """``x`` to so many digits as its exact binary value rounds, halves to even: 2.675, which is held as a little less, is 2.67, and 0.125 is 0.12.

    The product with the power of ten is held with its rounding error, found by splitting x in halves whose products are exact; the error decides
    where the product alone seems to lie half-way. Of numbers too large to have such digits nothing is rounded off; null, NaN and infinities stay.
    """
    scale = float(10**digits)

    def of(v: Column) -> Column:
        high = v * F.lit(_SPLIT) - (v * F.lit(_SPLIT) - v)
        product = v * F.lit(scale)
        error = (high * F.lit(scale) - product) + (v - high) * F.lit(scale)
        whole = F.floor(product).cast("double")
        over = (product - whole) - F.lit(0.5)
        odd = F.pmod(whole, F.lit(2.0)) == 1.0
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & odd)))
        near = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
        return F.when(F.isnan(v) | (F.abs(v) >= F.lit(float(1 << 52) / scale)), v).otherwise(F.when((near == 0) & (v < 0), F.lit(-0.0)).otherwise(near))

    return let(x.cast("double"), of)
