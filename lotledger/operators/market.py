"""Market analytics over the keyed lot table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions.images import ordered_distinct
from lotledger.functions.numbers import percent_change, ratio, truthy, whole
from lotledger.functions.titles import display_name
from lotledger.operators.filters import sold_only
from lotledger.operators.medians import profile

MOVEMENT_DAYS = (30, 90, 365)
TEXT_FACETS = {
    "sources": "source",
    "makes": "make",
    "models": "model",
    "transmissions": "transmission",
    "exterior_colors": "exterior_color",
    "auction_statuses": "auction_status",
}
LIST_ITEM = [
    "id", "source", "canonical_url", "auction_status", "sold_price", "high_bid", "bid_count", "currency",
    "ended_at", "year", "make", "model", "trim", "mileage", "exterior_color", "transmission", "title",
    "subtitle",
]
DEPRECIATION_POINT = [
    "id", "ended_at", "year", "make", "model", "trim", "mileage", "exterior_color", "transmission",
    "sold_price", "high_bid", "auction_status", "source", "canonical_url", "title",
]
BIN_WIDTH = 50_000


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def facet_values(lots: DataFrame) -> DataFrame:
    """(facet, value, year_value): sorted distinct filled values of all facets, one pass.

    Years sort as numbers and come in `year_value`; the other facets in `value`.
    """
    wide = lots.select(
        *[F.col(c).alias(f) for f, c in TEXT_FACETS.items()], F.col("year").cast("string").alias("years")
    )
    long = wide.unpivot([], [*TEXT_FACETS, "years"], "facet", "value")
    filled = long.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    return filled.withColumn(
        "year_value", F.when(F.col("facet") == "years", F.col("value")).cast("int")
    ).orderBy("facet", F.asc_nulls_first("year_value"), "value")


def facet_ranges(lots: DataFrame) -> DataFrame:
    """Bounds of price, mileage and end date over the whole table, one row."""
    ended = F.to_date("ended_at")
    return lots.agg(
        F.min("sold_price").alias("price_minimum"),
        F.max("sold_price").alias("price_maximum"),
        F.min("mileage").alias("mileage_minimum"),
        F.max("mileage").alias("mileage_maximum"),
        F.min(ended).alias("date_minimum"),
        F.max(ended).alias("date_maximum"),
    )


def _days_before(anchor: Column, days: int) -> Column:
    return anchor - F.make_dt_interval(days=F.lit(days))


def market_summary(lots: DataFrame, windows: tuple[int, ...] = MOVEMENT_DAYS) -> DataFrame:
    """KPI row: counts, median/average/low/high price, average mileage, sell-through, movement.

    Two passes: one for the totals and the latest priced end time (a scalar subquery that is
    run once), one that reduces the priced rows to (age band, price) with their number. The
    bands are cut at N and 2N days before that time, so every movement window is a union of
    bands and all price figures come from the reduced table.
    """
    slim = lots.select("sold_price", "mileage", "ended_at")
    totals = slim.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.count("mileage").alias("mileage_n"),
            F.sum(F.col("mileage").cast("long")).alias("mileage_total"),
            F.max(F.when(F.col("sold_price").isNotNull(), F.col("ended_at"))).alias("anchor"),
        ).alias("totals")
    ).scalar()
    edges = sorted({n * k for n in windows for k in (1, 2)})
    band = F.lit(None).cast("int")
    for i, days in reversed(list(enumerate(edges))):
        band = F.when(F.col("ended_at") >= _days_before(totals["anchor"], days), i).otherwise(band)
    reduced = (
        slim.where(F.col("sold_price").isNotNull())
        .groupBy(band.alias("band"), "sold_price")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def members(low: int, high: int) -> list[int]:
        return [i for i, days in enumerate(edges) if low < days <= high]

    samples = [("all", F.lit(True))]
    for n in windows:
        for label, low, high in ((f"now_{n}", 0, n), (f"before_{n}", n, 2 * n)):
            inside = F.coalesce(F.col("band").isin(members(low, high)), F.lit(False))
            samples.append((label, inside & (F.col("sold_price") != 0)))
    labels = F.filter(
        F.array(*[F.when(test, F.lit(label)) for label, test in samples]), lambda s: s.isNotNull()
    )
    counts = (
        reduced.select(F.explode(labels).alias("sample"), "sold_price", "n")
        .groupBy("sample", "sold_price")
        .agg(F.sum("n").alias("n"))
    )
    everything = F.col("sample") == "all"
    stats = profile(counts, ["sample"], "sold_price").agg(
        *[F.max(F.when(everything, F.col(c))).alias(c) for c in ("n", "total", "lowest", "highest", "median")],
        *[F.max(F.when(F.col("sample") == s, whole(F.col("median")))).alias(s) for s, _ in samples[1:]],
    )
    sold = F.coalesce("n", F.lit(0)).cast("long")
    mileage_n = totals["mileage_n"]
    return stats.select(
        totals["rows"].alias("total_count"),
        sold.alias("sold_count"),
        whole(F.col("median")).alias("median_sale_price"),
        whole(F.col("total") / F.col("n")).alias("average_sale_price"),
        F.col("lowest").alias("low_sale_price"),
        F.col("highest").alias("high_sale_price"),
        whole(F.when(mileage_n > 0, totals["mileage_total"] / mileage_n)).alias("average_mileage"),
        ratio(sold, totals["rows"], 3).alias("sell_through_rate"),
        *[
            percent_change(F.col(f"now_{n}"), F.col(f"before_{n}")).alias(f"movement_{n}_day")
            for n in windows
        ],
    )


def price_history(lots: DataFrame) -> DataFrame:
    """Monthly average, median, minimum, maximum and count of sale prices, oldest first."""
    priced = lots.where(F.col("ended_at").isNotNull() & F.col("sold_price").isNotNull())
    month = F.trunc(F.to_date("ended_at"), "month").alias("month")
    counts = priced.groupBy(month, "sold_price").agg(F.count(F.lit(1)).alias("n"))
    return (
        profile(counts, ["month"], "sold_price")
        .select(
            "month",
            whole(F.col("total") / F.col("n")).alias("average_price"),
            whole(F.col("median")).alias("median_price"),
            F.col("lowest").alias("minimum_price"),
            F.col("highest").alias("maximum_price"),
            F.col("n").alias("count"),
        )
        .orderBy("month")
    )


def depreciation_points(lots: DataFrame) -> DataFrame:
    """One point per dated sale with a price other than 0."""
    return (
        lots.where(sold_only() & F.col("ended_at").isNotNull() & truthy(F.col("sold_price")))
        .select(*DEPRECIATION_POINT)
        .orderBy(F.asc_nulls_last("ended_at"), "id")
    )


def price_trend(lots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least-squares line of sale price over the epoch day; no row without a point.

    `points` holds the line at the first and the last day, or the one point there is.
    """
    groups = by or []
    x = F.unix_date(F.to_date("ended_at")).cast("double")
    y = F.col("sold_price").cast("double")
    points = lots.where(sold_only() & F.col("ended_at").isNotNull() & truthy(F.col("sold_price")))
    fitted = points.select(*groups, x.alias("x"), y.alias("y")).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("_slope"),
        F.avg("y").alias("mean_y"),
        F.avg("x").alias("mean_x"),
        F.min("x").alias("first_x"),
        F.max("x").alias("last_x"),
    )
    flat = F.col("first_x") == F.col("last_x")
    line = fitted.where(F.col("n") > 0).withColumn(
        "_slope", F.when(flat, F.lit(0.0)).otherwise(F.col("_slope"))
    )
    line = line.withColumn("_intercept", F.col("mean_y") - F.col("_slope") * F.col("mean_x"))

    def at(name: str) -> Column:
        value = F.col("_slope") * F.col(name) + F.col("_intercept")
        return F.struct(F.col(name).alias("x"), F.bround(value, 2).alias("y"))

    single = F.col("n") == 1
    return line.select(
        *groups,
        "n",
        F.bround("_slope", 4).alias("slope"),
        F.when(single, F.col("mean_y")).otherwise(F.bround("_intercept", 2)).alias("intercept"),
        F.when(single, F.array(F.struct(F.col("first_x").alias("x"), F.col("mean_y").alias("y"))))
        .otherwise(F.array(at("first_x"), at("last_x")))
        .alias("points"),
    )


def asking_price() -> Column:
    """The sale price, else the highest bid."""
    return F.coalesce(F.col("sold_price"), F.col("high_bid"))


def price_histogram(lots: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Number of lots per price bin of `width`, labelled in thousands."""
    price = asking_price()
    start = F.floor(price / width).cast("long") * (width // 1000)
    return (
        lots.where(truthy(price))
        .groupBy(start.alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.concat(F.col("bin_start").cast("string"), F.lit("K")).alias("bucket"), "bin_start", "count")
        .orderBy("bin_start")
    )


def mileage_price_points(lots: DataFrame) -> DataFrame:
    price = asking_price()
    return lots.where(truthy(F.col("mileage")) & truthy(price)).select(
        "mileage", price.alias("price"), F.col("title").alias("name")
    )


def list_items(lots: DataFrame) -> DataFrame:
    """Columns of a result list; images are counted on the lot itself."""
    images = F.size(F.coalesce(F.col("image_urls"), F.array().cast("array<string>")))
    return lots.select(*LIST_ITEM, images.alias("image_count"))


def named_lots(lots: DataFrame) -> DataFrame:
    name = display_name(F.col("title"), F.col("year"), F.col("make"), F.col("model"), F.col("trim"))
    return lots.select("id", name.alias("display_name"))


def by_id(df: DataFrame, wanted: str, column: str = "id") -> DataFrame:
    """The row with that id; no row when there is none."""
    return df.where(F.col(column) == wanted)


def image_rows(lots: DataFrame) -> DataFrame:
    """Child rows: distinct filled image URLs with their position."""
    return lots.select(
        F.col("id").alias("lot_id"),
        "source",
        F.posexplode(ordered_distinct(F.col("image_urls"))).alias("position", "image_url"),
    )


def image_counts(lots: DataFrame, images: DataFrame) -> DataFrame:
    """Lots with the number of their rows in a separate image table, 0 without any."""
    counted = images.groupBy(F.col("lot_id").alias("id")).agg(F.count(F.lit(1)).alias("image_count"))
    return lots.join(counted, "id", "left").withColumn(
        "image_count", F.coalesce("image_count", F.lit(0).cast("long"))
    )


def lot_details(lots: DataFrame) -> DataFrame:
    """Full record with the images nested by position."""
    nested = F.transform(
        F.coalesce(F.col("image_urls"), F.array().cast("array<string>")),
        lambda url, position: F.struct(position.alias("position"), url.alias("image_url")),
    )
    return lots.withColumn("images", nested).drop("image_urls", "detail_html")
