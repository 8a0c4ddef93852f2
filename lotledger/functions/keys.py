"""Keys of lots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_key(source: Column, auction_id: Column, url: Column) -> Column:
    """`source:id:<id>`, or `source:url:<url>` without an id."""
    return F.when(
        F.coalesce(auction_id, F.lit("")) != "", F.concat_ws(":", source, F.lit("id"), auction_id)
    ).otherwise(F.concat_ws(":", source, F.lit("url"), url))


def lot_id(key: Column) -> Column:
    """Deterministic id, so that a retried task writes the same rows."""
    return F.sha2(key, 256)
