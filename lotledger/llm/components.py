"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm.tables import stored


def connected(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component, for every linked node but the smallest ones themselves.

    links: (a, b), either way round, repeated or not. Every step is a grouped minimum and a join, so a node with very
    many links is pre-aggregated and split like any other key; each round is kept as a table.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(links.select("a", "b").where(a != b).distinct(), "links")
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(b == F.col("low"), a).otherwise(b).alias("a"), F.col("low").alias("b"))
        now = stored(small.where(a != b).distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(a.alias("node"), b.alias("label"))
        seen = state
