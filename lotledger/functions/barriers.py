"""Keeping computed columns in one piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and the given columns, evaluated exactly once per row.

    A filter on a computed column is normally pushed below the projection, with the whole
    expression copied into it; for the wide extraction columns the copies grow beyond any
    useful plan. A generator over a single row stops that and costs next to nothing.
    """
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    # Two steps: the projection is compiled, the generator only unpacks its result. The outer
    # form keeps the optimizer from adding a filter on the array's size.
    return df.select(*keep, made.alias("_made")).select(*keep, F.inline_outer("_made"))
