"""JSON objects kept as MAP<STRING,STRING>: every value is a JSON fragment.

The fragment keeps numbers, texts, nulls, lists and objects apart, can be grouped,
compared and written to any file format, and `to_object` puts the object together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_fragment(value: Column) -> Column:
    """JSON fragment of a text column (NULL becomes `null`)."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNotNull(), quoted).otherwise("null")


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def merged(left: Column, right: Column) -> Column:
    """Union of two maps in which the right side wins (needs LAST_WIN)."""
    return F.map_concat(F.coalesce(left, empty_map()), F.coalesce(right, empty_map()))


def to_object(entries: Column) -> Column:
    """The map as one JSON object with sorted keys."""
    pairs = F.transform(
        F.array_sort(F.map_entries(entries)),
        lambda e: F.concat(text_fragment(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def last_entries(df: DataFrame, keys: list[str], entries: str, order: str) -> DataFrame:
    """Per key group, for every map key the entry with the highest `order`.

    The result column `entries` is array<struct<key,value,at>>. Both aggregations combine
    on the map side and the second one sees one row per distinct map key, so a group with
    a huge number of records is never held whole.
    """
    exploded = df.select(*keys, order, F.explode(entries).alias("_k", "_v"))
    latest = exploded.groupBy(*keys, "_k").agg(
        F.max(F.struct(F.col(order).alias("at"), F.col("_v").alias("value"))).alias("_last")
    )
    return latest.groupBy(*keys).agg(
        F.collect_list(
            F.struct(F.col("_k").alias("key"), F.col("_last.value").alias("value"), F.col("_last.at").alias("at"))
        ).alias(entries)
    )


def entries_to_map(entries: Column) -> Column:
    """array<struct<key,value,...>> as a map; NULL stays NULL."""
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    )
