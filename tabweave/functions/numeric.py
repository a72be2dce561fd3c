"""Numeric column expressions that Spark has no builtin for."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's double-precision rational approximation of the normal tail, highest power first.
NORM_TAIL_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORM_TAIL_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735823752,
)


def rounded(col: Column, places: int) -> Column:
    """Half-up rounding that never yields a negative zero."""
    r = F.round(col, places)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function, accurate to about 1e-14, inside generated code."""
    y = F.abs(z)
    density = F.exp(-y * y / 2)
    centre = density * _polynomial(y, NORM_TAIL_NUMERATOR) / _polynomial(y, NORM_TAIL_DENOMINATOR)
    fraction = y + F.lit(0.65)
    for step in (4, 3, 2, 1):
        fraction = y + F.lit(float(step)) / fraction
    far = density / fraction / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(y > 37, F.lit(0.0)).when(y < 5 * math.sqrt(2), centre).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def plain_number(x: Column) -> Column:
    """A double as decimal text without an exponent."""
    fixed = F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), "0+$", "")
    fixed = F.regexp_replace(fixed, r"\.$", ".0")
    short = (x == 0) | ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7))
    return F.when(short, x.cast("string")).otherwise(F.coalesce(fixed, x.cast("string")))
