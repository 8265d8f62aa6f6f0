"""Scalar functions of fixed-point arithmetic (1024 stands for 1) and of bits, as column expressions.

The exact value is given, rounded to an integer; table-driven approximations are not followed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ten_log10(x: Column) -> Column:
    return F.round(F.log10(x.cast("double")) * 10240).cast("long")


def sin1024(x: Column) -> Column:
    return F.round(F.sin(x / 1024.0) * 1024).cast("long")


def cos1024(x: Column) -> Column:
    return F.round(F.cos(x / 1024.0) * 1024).cast("long")


def log2_1024(x: Column) -> Column:
    return F.round(F.log2(x.cast("double")) * 1024).cast("long")


def sqrt1024(x: Column) -> Column:
    return F.round(F.sqrt(x.cast("double")) * 1024).cast("long")


def clip255(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def positive_or_null(x: Column) -> Column:
    """The value, or 0 where it is negative."""
    return F.greatest(x, F.lit(0))


def is_in(x: Column, low: int, high: int) -> Column:
    return (x >= low) & (x < high)


def is_power_of_2(x: Column) -> Column:
    """Whether one bit at most is set; so 0 counts."""
    return x.bitwiseAND(x - 1) == 0


def reset_lowest_bit(x: Column) -> Column:
    return x.bitwiseAND(x - 1)


def lowest_bit(x: Column) -> Column:
    return x.bitwiseAND(-x)


def highest_bit(x: Column) -> Column:
    """The highest set bit of a positive number, 0 for 0."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x)) - 1)).cast("long")


def round_up_power_of_2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1)))).cast("long")
