"""Registered market queries."""

from __future__ import annotations

from datetime import date
from hashlib import sha256

from pyspark.sql import functions as F

from lotledger.functions.titles import display_name
from lotledger.operators import filters, market, paging
from lotledger.operators.filters import chart_criteria, keep, market_predicates
from lotledger.plans.oracle_views import LOTS
from lotledger.plans.registry import Registry
from lotledger.sources.observed import lots, observations

REGISTRY = Registry()
register = REGISTRY.query

ITEM_SQL = """id, source, canonical_url, auction_status, sold_price, high_bid, bid_count, currency,
 ended_at, year, make, model, "trim", mileage, exterior_color, transmission, title, subtitle"""
SLIM = ["id", "source", "auction_status", "sold_price", "ended_at", "year", "make", "model", "mileage"]
SLIM_SQL = "id, source, auction_status, sold_price, ended_at, year, make, model, mileage"


@register(
    "lots_scan_oldest_first",
    LOTS + f"SELECT {SLIM_SQL} FROM lots ORDER BY ended_at ASC NULLS LAST, id",
)
def _(spark, folder):
    return lots(spark, folder).select(*SLIM).orderBy(F.asc_nulls_last("ended_at"), "id")


@register(
    "filter_listed_values",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE source IN ('bring_a_trailer')
 AND auction_status IN ('sold', 'withdrawn') AND make IN ('Brand#1', 'Brand#2', 'Brand#7')
 AND model IN ('ECONOMY', 'SMALL') AND transmission IN ('A', 'R') AND exterior_color IN ('red', 'blue', 'small')""",
)
def _(spark, folder):
    wanted = market_predicates(
        source=["bring_a_trailer"],
        auction_status=["sold, withdrawn"],
        make=["Brand#1,Brand#2", " Brand#7 "],
        model="ECONOMY,SMALL",
        transmission=["A", "R", " "],
        exterior_color=["red,blue,small"],
    )
    return keep(lots(spark, folder), wanted).select(*SLIM)


@register(
    "filter_year_and_mileage",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE year >= 1980 AND year <= 1999
 AND mileage >= 10000 AND mileage <= 30000""",
)
def _(spark, folder):
    wanted = market_predicates(year_min=1980, year_max=1999, mileage_min=10000, mileage_max=30000)
    return keep(lots(spark, folder), wanted).select(*SLIM)


@register(
    "filter_end_dates",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE CAST(ended_at AS DATE) >= DATE '1997-01-31'
 AND CAST(ended_at AS DATE) <= DATE '1998-06-30'""",
)
def _(spark, folder):
    wanted = market_predicates(ended_from=date(1997, 1, 31), ended_to=date(1998, 6, 30))
    return keep(lots(spark, folder), wanted).select(*SLIM)


@register(
    "filter_sold_only",
    LOTS + f"SELECT {SLIM_SQL} FROM lots WHERE auction_status = 'sold' AND sold_price IS NOT NULL",
)
def _(spark, folder):
    return keep(lots(spark, folder), market_predicates(only_sold=True)).select(*SLIM)


@register(
    "filter_price_range",
    LOTS + f"SELECT {SLIM_SQL} FROM lots WHERE sold_price >= 20000 AND sold_price <= 60000",
)
def _(spark, folder):
    return keep(lots(spark, folder), market_predicates(price_min=20000, price_max=60000)).select(*SLIM)


@register(
    "filter_free_text",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE title ILIKE '%BRAND#1_ eco%' OR make ILIKE '%BRAND#1_ eco%'
 OR model ILIKE '%BRAND#1_ eco%' OR "trim" ILIKE '%BRAND#1_ eco%'""",
)
def _(spark, folder):
    return keep(lots(spark, folder), market_predicates(search="  BRAND#1_ eco ")).select(*SLIM)


@register(
    "filter_all_criteria",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE source = 'cars_and_bids' AND auction_status = 'sold'
 AND year BETWEEN 1978 AND 2015 AND mileage BETWEEN 5000 AND 45000 AND sold_price BETWEEN 10000 AND 80000
 AND CAST(ended_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
 AND (title ILIKE '%ring%' OR make ILIKE '%ring%' OR model ILIKE '%ring%' OR "trim" ILIKE '%ring%')""",
)
def _(spark, folder):
    wanted = market_predicates(
        source=["cars_and_bids"],
        year_min=1978,
        year_max=2015,
        mileage_min=5000,
        mileage_max=45000,
        price_min=10000,
        price_max=80000,
        ended_from=date(1996, 1, 1),
        ended_to=date(2000, 12, 31),
        only_sold=True,
        search="Ring",
    )
    return keep(lots(spark, folder), wanted).select(*SLIM)


@register(
    "operations_lot_filter",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE source = 'bring_a_trailer' AND auction_status <> 'sold'
 AND make ILIKE '%rand#1%' AND model ILIKE '%conom%' AND CAST(ended_at AS DATE) >= DATE '1997-01-01'
 AND CAST(ended_at AS DATE) <= DATE '1999-12-31'
 ORDER BY ended_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 50""",
)
def _(spark, folder):
    wanted = filters.operations_predicates(
        source="bring_a_trailer", make="RAND#1", model="conom", ended_from=date(1997, 1, 1),
        ended_to=date(1999, 12, 31), is_sold=False,
    )
    rows = keep(lots(spark, folder), wanted)
    return paging.page(rows, 1, 50, paging.sort_keys()).select(*SLIM)


@register(
    "operations_lot_filter_year",
    LOTS + f"SELECT {SLIM_SQL} FROM lots WHERE year = 1990 AND auction_status = 'sold'",
)
def _(spark, folder):
    wanted = filters.operations_predicates(year=1990, is_sold=True)
    return keep(lots(spark, folder), wanted).select(*SLIM)


@register("lots_total", LOTS + "SELECT count(*) AS total FROM lots WHERE make = 'Brand#3'")
def _(spark, folder):
    return market.total_count(keep(lots(spark, folder), market_predicates(make="Brand#3")))


_FACETS = [
    ("sources", "source"), ("makes", "make"), ("models", "model"), ("transmissions", "transmission"),
    ("exterior_colors", "exterior_color"), ("auction_statuses", "auction_status"),
]


@register(
    "market_facets",
    LOTS
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{f}' AS facet, {c} AS value, CAST(NULL AS INTEGER) AS year_value "
        f"FROM lots WHERE {c} IS NOT NULL AND {c} <> ''"
        for f, c in _FACETS
    )
    + " UNION ALL SELECT DISTINCT 'years', CAST(year AS VARCHAR), year FROM lots WHERE year IS NOT NULL",
)
def _(spark, folder):
    return market.facet_values(lots(spark, folder))


@register(
    "market_facet_ranges",
    LOTS + """SELECT min(sold_price) AS price_minimum, max(sold_price) AS price_maximum,
 min(mileage) AS mileage_minimum, max(mileage) AS mileage_maximum,
 min(CAST(ended_at AS DATE)) AS date_minimum, max(CAST(ended_at AS DATE)) AS date_maximum FROM lots""",
)
def _(spark, folder):
    return market.facet_ranges(lots(spark, folder, vehicle=False))


def _summary_sql(condition: str = "TRUE") -> str:
    moves = ",\n ".join(
        f"CASE WHEN p{n} <> 0 THEN CAST(round_even(CAST(c{n} - p{n} AS DOUBLE) / p{n} * 100, 1) AS DOUBLE) END"
        f" AS movement_{n}_day"
        for n in market.MOVEMENT_DAYS
    )
    medians = ",\n ".join(
        f"CAST(round_even(median(sold_price) FILTER (sold_price <> 0 AND ended_at >= a - INTERVAL {n} DAY), 0)"
        f" AS INTEGER) AS c{n},\n"
        f" CAST(round_even(median(sold_price) FILTER (sold_price <> 0 AND ended_at >= a - INTERVAL {2 * n} DAY"
        f" AND ended_at < a - INTERVAL {n} DAY), 0) AS INTEGER) AS p{n}"
        for n in market.MOVEMENT_DAYS
    )
    return (
        LOTS
        + f""", chosen AS (SELECT * FROM lots WHERE {condition}),
anchored AS (SELECT *, max(ended_at) FILTER (sold_price IS NOT NULL) OVER () AS a FROM chosen),
figures AS (SELECT count(*) AS total_count, count(sold_price) AS sold_count,
 CAST(round_even(median(sold_price), 0) AS INTEGER) AS median_sale_price,
 CAST(round_even(avg(sold_price), 0) AS INTEGER) AS average_sale_price,
 min(sold_price) AS low_sale_price, max(sold_price) AS high_sale_price,
 CAST(round_even(avg(mileage), 0) AS INTEGER) AS average_mileage,
 CAST(CASE WHEN count(*) > 0 THEN round_even(CAST(count(sold_price) AS DOUBLE) / count(*), 3) END AS DOUBLE)
   AS sell_through_rate,
 {medians}
FROM anchored)
SELECT total_count, sold_count, median_sale_price, average_sale_price, low_sale_price, high_sale_price,
 average_mileage, sell_through_rate, {moves} FROM figures"""
    )


@register("market_summary", _summary_sql())
def _(spark, folder):
    return market.market_summary(lots(spark, folder, vehicle=False))


@register("market_summary_of_make", _summary_sql("make = 'Brand#7'"))
def _(spark, folder):
    return market.market_summary(keep(lots(spark, folder), market_predicates(make="Brand#7")))


@register("market_summary_of_nothing", _summary_sql("make = 'no such make'"))
def _(spark, folder):
    return market.market_summary(keep(lots(spark, folder), market_predicates(make="no such make")))


_HISTORY = """SELECT CAST(date_trunc('month', ended_at) AS DATE) AS month,
 CAST(round_even(avg(sold_price), 0) AS INTEGER) AS average_price,
 CAST(round_even(median(sold_price), 0) AS INTEGER) AS median_price,
 min(sold_price) AS minimum_price, max(sold_price) AS maximum_price, count(*) AS "count"
 FROM lots WHERE auction_status = 'sold' AND sold_price IS NOT NULL AND ended_at IS NOT NULL {more}
 GROUP BY 1 ORDER BY 1"""


@register("price_history", LOTS + _HISTORY.format(more=""))
def _(spark, folder):
    rows = keep(lots(spark, folder, vehicle=False), market_predicates(only_sold=True))
    return market.price_history(rows)


@register("price_history_chart", LOTS + _HISTORY.format(more="AND make IN ('Brand#1', 'Brand#2') AND year >= 1985"))
def _(spark, folder):
    asked = {"auction_status": ["withdrawn"], "make": ["Brand#1", "Brand#2"], "year_min": 1985}
    return market.price_history(keep(lots(spark, folder), market_predicates(**chart_criteria(asked))))


def _trend_sql(group: str) -> str:
    keys, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return (
        LOTS
        + f""", points AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(ended_at AS DATE)) AS DOUBLE) AS x,
  CAST(sold_price AS DOUBLE) AS y FROM lots
  WHERE auction_status = 'sold' AND sold_price <> 0 AND ended_at IS NOT NULL),
centred AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM points
  WINDOW w AS ({f'PARTITION BY {group}' if group else ''})),
fitted AS (SELECT {keys} count(*) AS n, avg(x) AS mx, avg(y) AS my, min(x) AS x0, max(x) AS x1,
  CASE WHEN min(x) = max(x) THEN 0 ELSE sum(dx * dy) / sum(dx * dx) END AS b FROM centred {by})
SELECT {keys} n, CAST(round_even(b, 4) AS DOUBLE) AS slope,
 CASE WHEN n = 1 THEN my ELSE CAST(round_even(my - b * mx, 2) AS DOUBLE) END AS intercept,
 x0 AS first_x, x1 AS last_x,
 CASE WHEN n = 1 THEN my ELSE CAST(round_even(b * x0 + (my - b * mx), 2) AS DOUBLE) END AS first_y,
 CASE WHEN n > 1 THEN CAST(round_even(b * x1 + (my - b * mx), 2) AS DOUBLE) END AS last_y
FROM fitted WHERE n > 0"""
    )


def _flat_points(trend):
    first, last = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    return trend.select(
        *[c for c in trend.columns if c != "points"],
        first["x"].alias("first_x"),
        F.coalesce(last["x"], first["x"]).alias("last_x"),
        first["y"].alias("first_y"),
        last["y"].alias("last_y"),
    )


@register("price_trend", _trend_sql(""))
def _(spark, folder):
    return _flat_points(market.price_trend(lots(spark, folder, vehicle=False)))


@register("price_trend_by_make", _trend_sql("make"))
def _(spark, folder):
    return _flat_points(market.price_trend(lots(spark, folder), by=["make"]))


@register("price_trend_by_vehicle", _trend_sql("make, model, year, transmission"))
def _(spark, folder):
    return _flat_points(market.price_trend(lots(spark, folder), by=["make", "model", "year", "transmission"]))


@register(
    "depreciation_points",
    LOTS + """SELECT id, ended_at, year, make, model, "trim", mileage, exterior_color, transmission, sold_price,
 high_bid, auction_status, source, canonical_url, title
 FROM lots WHERE auction_status = 'sold' AND sold_price <> 0 AND ended_at IS NOT NULL""",
)
def _(spark, folder):
    return market.depreciation_points(lots(spark, folder))


@register(
    "price_histogram",
    LOTS + """SELECT concat(CAST(floor(coalesce(sold_price, high_bid) / 50000) AS BIGINT) * 50, 'K') AS bucket,
 CAST(floor(coalesce(sold_price, high_bid) / 50000) AS BIGINT) * 50 AS bin_start, count(*) AS "count"
 FROM lots WHERE coalesce(sold_price, high_bid) <> 0 GROUP BY ALL""",
)
def _(spark, folder):
    return market.price_histogram(lots(spark, folder, vehicle=False))


@register(
    "price_histogram_of_page",
    LOTS + """, shown AS (SELECT * FROM lots ORDER BY ended_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 200)
SELECT concat(CAST(floor(coalesce(sold_price, high_bid) / 50000) AS BIGINT) * 50, 'K') AS bucket,
 CAST(floor(coalesce(sold_price, high_bid) / 50000) AS BIGINT) * 50 AS bin_start, count(*) AS "count"
 FROM shown WHERE coalesce(sold_price, high_bid) <> 0 GROUP BY ALL""",
)
def _(spark, folder):
    rows = lots(spark, folder, vehicle=False)
    return market.price_histogram(paging.page(rows, 1, 200, paging.sort_keys()))


@register(
    "mileage_price_points",
    LOTS + """SELECT mileage, coalesce(sold_price, high_bid) AS price, title AS name FROM lots
 WHERE mileage <> 0 AND coalesce(sold_price, high_bid) <> 0""",
)
def _(spark, folder):
    return market.mileage_price_points(lots(spark, folder))


@register("lot_list_items", LOTS + f"SELECT {ITEM_SQL}, 2 AS image_count FROM lots")
def _(spark, folder):
    return market.list_items(lots(spark, folder))


@register(
    "lot_display_names",
    LOTS + """SELECT id, CASE WHEN transmission = 'A' THEN title ELSE
 coalesce(nullif(concat_ws(' ', CASE WHEN transmission = 'R' THEN year END,
   CASE WHEN transmission = 'R' THEN make END), ''), 'Unknown vehicle') END AS display_name FROM lots""",
)
def _(spark, folder):
    rows = lots(spark, folder)
    title = F.when(F.col("transmission") == "A", F.col("title"))
    year = F.when(F.col("transmission") == "R", F.col("year"))
    make = F.when(F.col("transmission") == "R", F.col("make"))
    return rows.select("id", display_name(title, year, make, F.lit("")).alias("display_name"))


@register(
    "lot_by_id",
    LOTS + f"SELECT {ITEM_SQL} FROM lots WHERE id = sha256('bring_a_trailer:id:10-1')",
)
def _(spark, folder):
    wanted = sha256(b"bring_a_trailer:id:10-1").hexdigest()
    return market.by_id(lots(spark, folder), wanted).select(*market.LIST_ITEM)


_ORDERS = {
    "ended_at_desc": "ended_at DESC NULLS FIRST",
    "ended_at_asc": "ended_at ASC NULLS LAST",
    "price_desc": "sold_price DESC NULLS FIRST",
    "price_asc": "sold_price ASC NULLS LAST",
    "mileage_desc": "mileage DESC NULLS FIRST",
    "mileage_asc": "mileage ASC NULLS LAST",
}


def _register_page(sort: str, clause: str) -> None:
    sql = (
        LOTS + f"SELECT {SLIM_SQL} FROM lots ORDER BY {clause}, created_at DESC NULLS FIRST, id LIMIT 50 OFFSET 50"
    )

    @register(f"lots_page_by_{sort}", sql)
    def _(spark, folder):
        rows, _total = paging.lots_page(lots(spark, folder), 2, 50, sort)
        return rows.select(*SLIM)


for _sort, _clause in _ORDERS.items():
    _register_page(_sort, _clause)


@register(
    "lots_page_deep",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots ORDER BY ended_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id
 LIMIT 100 OFFSET 2000""",
)
def _(spark, folder):
    return paging.page(lots(spark, folder), 21, 100, paging.sort_keys()).select(*SLIM)


@register(
    "lots_page_after_key",
    LOTS + f"""SELECT {SLIM_SQL} FROM lots WHERE sold_price < 60000 OR (sold_price = 60000 AND
 (created_at < TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND id > '8')))
 ORDER BY sold_price DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 100""",
)
def _(spark, folder):
    last = {"sold_price": 60000, "created_at": F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), "id": "8"}
    return paging.page_after(lots(spark, folder), last, 100, paging.sort_keys("price_desc")).select(*SLIM)


_IMAGES = """, seen AS (SELECT DISTINCT id AS lot_id, l_partkey, l_suppkey FROM keyed WHERE detail_scraped_at IS NOT NULL)
"""


def _seen_images(spark, folder):
    """Image table: what all detailed observations of a lot showed."""
    seen = observations(spark, folder, vehicle=False).where(F.col("detail_scraped_at").isNotNull())
    return seen.select(F.col("id").alias("lot_id"), F.element_at("image_urls", 1).alias("a"),
                       F.element_at("image_urls", 2).alias("b")).distinct()


@register(
    "image_count_per_lot",
    LOTS + _IMAGES + """SELECT id, count(lot_id) AS image_count FROM lots LEFT JOIN seen ON id = lot_id GROUP BY id""",
)
def _(spark, folder):
    rows = lots(spark, folder, vehicle=False).select("id")
    return market.image_counts(rows, _seen_images(spark, folder))


@register(
    "lot_images_nested",
    LOTS + """SELECT id, 2 AS image_count, concat('https://img.example/p/', l_partkey) AS first_image,
 concat('https://img.example/s/', l_suppkey) AS second_image FROM lots""",
)
def _(spark, folder):
    nested = market.lot_details(lots(spark, folder, vehicle=False))
    return nested.select(
        "id",
        F.size("images").alias("image_count"),
        F.get("images", F.lit(0))["image_url"].alias("first_image"),
        F.get("images", F.lit(1))["image_url"].alias("second_image"),
    )


@register(
    "lot_image_rows",
    LOTS + """SELECT id AS lot_id, source, 0 AS position, concat('https://img.example/p/', l_partkey) AS image_url FROM lots
 UNION ALL SELECT id, source, 1, concat('https://img.example/s/', l_suppkey) FROM lots""",
)
def _(spark, folder):
    return market.image_rows(lots(spark, folder, vehicle=False))
