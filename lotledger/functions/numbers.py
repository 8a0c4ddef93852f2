"""Half-to-even rounding and exact averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """Round half to even, as an integer column."""
    return F.bround(value, 0).cast("int")


def ratio(part: Column, total: Column, digits: int) -> Column:
    """part / total with `digits` decimals, NULL when total is 0."""
    return F.when(total != 0, F.bround(part.cast("double") / total.cast("double"), digits))


def percent_change(current: Column, previous: Column) -> Column:
    """Relative change in percent with one digit; NULL without a non-zero base."""
    return F.when(
        previous != 0,
        F.bround((current - previous).cast("double") / previous.cast("double") * 100, 1),
    )


def truthy(value: Column) -> Column:
    """Present and not zero."""
    return value.isNotNull() & (value != 0)
