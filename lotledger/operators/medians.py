"""Exact medians of whole numbers without a group in one task.

The built-in exact median merges all distinct values of a group in one task. Here equal
values are counted first (with map-side combine, so a hot group costs nothing extra) and
the middle is then located in two steps over the counts: the bin that holds it, then the
value inside that bin. With 32-bit values the first step sees at most 2**16 bins per group
and the second at most 2**16 values per bin, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_BITS = 16


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct values of each group with their number (`n`)."""
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def _holds(rank: Column) -> Column:
    return (F.col("_before") < rank) & (rank <= F.col("_upto"))


def profile(counts: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group: n, total, lowest, highest and the exact median (double).

    `counts` has one row per group and value with its number in `n`; NULL values do not
    take part. A group without values gives no row.
    """
    bins = [*groups, "_bin"]
    binned = (
        counts.where(F.col(value).isNotNull())
        .withColumn("_bin", F.shiftright(F.col(value), BIN_BITS))
        .repartition(*[F.col(c) for c in bins])
    )
    per_bin = binned.groupBy(*bins).agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * F.col(value).cast("long")).alias("_total"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
    )
    whole = W.partitionBy(*groups)
    running = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = per_bin.select(
        *bins,
        F.sum("_n").over(running).alias("_upto"),
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("n"),
        F.sum("_total").over(whole).alias("total"),
        F.min("_low").over(whole).alias("lowest"),
        F.max("_high").over(whole).alias("highest"),
    ).withColumns(
        {"_first": F.expr("(n + 1) div 2"), "_second": F.expr("(n + 2) div 2")}
    )
    middle = ranked.where(_holds(F.col("_first")) | _holds(F.col("_second")))
    inside = W.partitionBy(*bins).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    located = (
        binned.select(*bins, value, F.col("n").alias("_n"))
        .join(middle.drop("_upto"), bins)
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    low = F.max(F.when(_holds(F.col("_first")), F.col(value)))
    high = F.max(F.when(_holds(F.col("_second")), F.col(value)))
    return located.groupBy(*groups).agg(
        *[F.max(c).alias(c) for c in ("n", "total", "lowest", "highest")],
        ((low.cast("double") + high.cast("double")) / 2).alias("median"),
    )
