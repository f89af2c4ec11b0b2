"""Arithmetic whose result does not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-even rounding to `digits` decimals."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def rounded_exactly(value: Column, digits: int = 4) -> Column:
    """The nearest number of `digits` decimals to the binary value itself, a true tie going to the even one.

    The product with the scale may round to a tie that is none; what it lost tells on which side the value is.
    """
    scale = float(10 ** digits)
    product = value * scale
    # The value in two halves, whose products with the scale are exact.
    upper = value * 134217729.0 - (value * 134217729.0 - value)
    lost = (upper * scale - product) + (value - upper) * scale
    below = F.floor(product).cast("double")
    nearest = F.when(product - below != 0.5, F.rint(product)).when(lost > 0, below + 1).when(lost < 0, below).otherwise(F.rint(product))
    return nearest / scale


def as_micros(seconds: Column) -> Column:
    """Seconds as whole microseconds."""
    return F.rint(seconds * 1e6).cast("long")


def exact_sum(value: Column) -> Column:
    """Sum of doubles to six decimals, added as integers so the order cannot matter."""
    return F.sum(as_micros(value)) / 1e6


def wide_sum(value: Column) -> Column:
    """Sum of longs as the nearest double; it is added in a decimal, since no long may hold it."""
    return F.sum(value.cast("decimal(19,0)")).cast("double")


def seconds_of(micros: Column) -> Column:
    return micros / 1e6


def ceil_div(value: Column, by: Column) -> Column:
    """Integer division rounded up, without passing through a double."""
    return F.expr("0").cast("long") - F.call_function("div", -value, by) + F.when(
        (value % by) > 0, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    """How many rows meet a condition; 0 for none."""
    return F.count(F.when(condition, 1))
