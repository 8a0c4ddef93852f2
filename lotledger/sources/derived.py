"""Scraped inputs derived from the given tables: list items, result pages, detail pages.

The order priority and the return flag decide which fields are missing or odd, so that all
skip reasons, value kinds and date forms occur. All derivations are plain projections of
observations: their size follows the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.sources.observed import describe, lot_columns, table

# (priority, flag) to the defect of the derived item; all others are sound.
DEFECTS = {
    ("1-URGENT", "A"): "no_title",
    ("1-URGENT", "N"): "parts_or_non_car",
    ("1-URGENT", "R"): "no_url",
    ("2-HIGH", "A"): "no_year",
    ("2-HIGH", "N"): "no_price",
    ("2-HIGH", "R"): "no_end_date",
    ("3-MEDIUM", "A"): "parse_error",
}


def _defect() -> Column:
    chain = F.lit(None).cast("string")
    for (priority, flag), reason in DEFECTS.items():
        test = (F.col("o_orderpriority") == priority) & (F.col("l_returnflag") == flag)
        chain = F.when(test, reason).otherwise(chain)
    return chain


def described_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with lot columns, their source columns and the `defect`."""
    rows = describe(table(spark, folder, "lineitem"), spark, folder, vehicle=True, place=True)
    columns = lot_columns(vehicle=True, place=True)
    return rows.withColumns({**columns, "defect": _defect()})


def _fields(*pairs: tuple[str, Column]) -> Column:
    """JSON object of the filled fields."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in pairs]))


def first_site_items(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, page, ord, item_json, defect: items as the first site lists them."""
    df = described_observations(spark, folder)
    defect, day = F.col("defect"), F.col("l_shipdate")
    has = lambda reason: F.coalesce(defect == reason, F.lit(False))
    miles = F.when(F.col("mileage").isNotNull(), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("k-Mile ")))
    vehicle = F.concat_ws(" ", "make", "model", "trim")
    title = F.concat(
        F.coalesce(miles, F.lit("")),
        F.when(has("no_year"), "").otherwise(F.concat(F.col("year").cast("string"), F.lit(" "))),
        vehicle,
        F.when(has("parts_or_non_car"), " Wheels").otherwise(""),
    )
    amount = F.format_number(F.col("high_bid"), 0)
    verb = (
        F.when(F.col("auction_status") == "sold", "Sold for USD $")
        .when(F.col("auction_status") == "reserve_not_met", "Bid to USD $")
        .otherwise("Listing withdrawn at USD $")
    )
    shown_day = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(day, "M/d/yyyy")).otherwise(
        F.date_format(day, "M/d/yy")
    )
    on = F.when(has("no_end_date"), "").otherwise(F.concat(F.lit(" <span> on "), shown_day, F.lit(" </span>")))
    text = (
        F.when(has("no_price"), F.concat(F.lit("Sold"), on))
        .when(has("parse_error"), F.concat(F.lit("Sold for $, "), on))
        .otherwise(F.concat(verb, amount, on))
    )
    ended = F.unix_timestamp(day.cast("timestamp")) + 3600
    stamp = F.when(
        (F.col("l_linestatus") == "F") & ~has("no_end_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", ended * 1000).otherwise(ended),
    )
    numbered = F.col("l_returnflag") != "N"
    common = [
        ("id", F.col("source_auction_id")),
        ("title", F.when(~has("no_title"), title)),
        ("url", F.when(has("no_url"), "").otherwise(F.col("canonical_url"))),
        ("sold_text", text),
        ("timestamp_end", stamp),
        ("bids", F.when(numbered, F.col("bid_count"))),
        ("num_bids", F.when(~numbered, F.concat(F.col("bid_count").cast("string"), F.lit(" bids")))),
        ("country", F.col("n_name")),
        ("noreserve", F.col("l_linestatus") == "O"),
        ("image", F.get("image_urls", F.lit(0))),
        ("images", F.array(F.struct(F.get("image_urls", F.lit(1)).alias("src")))),
    ]
    bid = F.when(
        numbered, _fields(*common, ("current_bid", F.col("high_bid")))
    ).otherwise(_fields(*common, ("current_bid", F.concat(F.lit("USD $"), amount))))
    return df.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("run_id"),
        F.col("l_suppkey").alias("page"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").alias("ord"),
        "l_orderkey", "l_linenumber", "l_partkey",
        bid.alias("item_json"),
        "defect",
    )


def second_site_items(spark: SparkSession, folder: str) -> DataFrame:
    """The same observations as the second site's API tells them."""
    df = described_observations(spark, folder)
    defect = F.col("defect")
    has = lambda reason: F.coalesce(defect == reason, F.lit(False))
    sold = F.col("auction_status") == "sold"
    status = F.when(sold, "sold").when(F.col("auction_status") == "reserve_not_met", "no_sale").otherwise("withdrawn")
    title = F.concat_ws(" ", F.when(~has("no_year"), F.col("year").cast("string")), "make", "model", "trim")
    seller_named = F.col("l_returnflag") == "N"
    common = [
        ("id", F.when(has("no_url"), "").otherwise(F.col("source_auction_id"))),
        ("title", F.when(~has("no_title"), title)),
        ("sub_title", F.concat(F.lit("~"), F.col("trim"), F.lit(", "), F.col("n_name"))),
        ("status", status),
        ("sale_amount", F.when(sold & ~has("no_price"), F.col("high_bid"))),
        ("current_bid", F.when(~has("no_price"), F.col("high_bid"))),
        ("bid_count", F.col("bid_count")),
        ("mileage", F.concat(F.format_number("mileage", 0), F.lit(" Miles"))),
        ("auction_end", F.date_format(F.col("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'")),
        ("transmission", F.col("l_returnflag")),
        ("drivetrain", F.when(F.col("l_linestatus") == "F", F.lit(""))),
        ("location", F.col("n_name")),
        ("no_reserve", F.col("l_linestatus") == "O"),
        (
            "main_photo",
            F.struct(F.lit("media.example/").alias("base_url"), F.concat(F.lit("/"), "source_auction_id", F.lit(".jpg")).alias("path")),
        ),
        ("photos", F.array(F.get("image_urls", F.lit(0)))),
    ]
    item = F.when(
        seller_named, _fields(*common, ("seller", F.struct(F.col("c_name").alias("username"))))
    ).otherwise(_fields(*common, ("seller", F.col("c_name"))))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", item.alias("item_json"), "defect")


def result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One result page per observation, as HTML with embedded data or as API JSON."""
    items = first_site_items(spark, folder)
    html_page = F.col("l_linenumber") % 3 != 0
    paging = F.concat(
        F.lit(',"items_total":'), (F.col("l_linenumber") * 24).cast("string"),
        F.lit(',"items_per_page":24,"page_current":1,"pages_total":'),
        F.when(F.col("l_linenumber") == 7, '" "').otherwise(F.col("l_linenumber").cast("string")),
    )
    base = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('{"keyword":"'), F.col("page").cast("string"), F.lit('"}'))).otherwise("[]")
    data = F.concat(F.lit('{"items":['), F.col("item_json"), F.lit("]"), paging)
    html = F.concat(
        F.lit("<html><body><script>var auctionsCompletedInitialData = "),
        data, F.lit(',"base_filter":'), base, F.lit("};\n</script></body></html>"),
    )
    number = F.concat_ws("-", F.col("ord.l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                         F.col("l_partkey").cast("string"), F.col("page").cast("string"),
                         F.date_format("ord.l_shipdate", "yyyyMMdd"))
    return items.select(
        number.alias("id"),
        F.lit("bring_a_trailer").alias("source"),
        F.when(html_page, "bat_model_page").otherwise("bat_api_completed_results").alias("target_type"),
        F.concat(F.lit("https://bringatrailer.com/make-"), F.col("page").cast("string"), F.lit("/")).alias("url"),
        F.when(html_page, "text/html").otherwise("application/json").alias("content_type"),
        F.when(html_page, html).otherwise(F.concat(data, F.lit("}"))).alias("content"),
        F.col("ord.l_shipdate").alias("fetched_at"),
        "l_orderkey", "l_linenumber", "l_partkey", F.col("page").alias("l_suppkey"), "defect",
    )


def directory_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One model directory per supplier; those of odd suppliers link to nothing but motorcycles."""
    rows = table(spark, folder, "supplier").select("s_suppkey")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("make-"), F.col("s_suppkey").cast("string"))).otherwise("motorcycles")
    link = F.concat(
        F.lit('<a class="previous-listing-image-link" href="https://bringatrailer.com/'), name,
        F.lit('/"><img src="x.jpg" alt="Model &amp; Co"></a>'),
    )
    return rows.select(
        F.concat(F.lit("d-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.lit("bring_a_trailer").alias("source"),
        F.lit("bat_models_directory").alias("target_type"),
        F.concat(F.lit("https://bringatrailer.com/models/?s="), F.col("s_suppkey").cast("string")).alias("url"),
        F.lit("text/html").alias("content_type"),
        F.concat(F.lit("<html><body>"), link, F.lit("</body></html>")).alias("content"),
        F.lit("1999-01-01").cast("timestamp_ntz").alias("fetched_at"),
    )


def captured_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One API answer of the second site per observation; observations with an item that cannot be read gave an empty answer."""
    items = second_site_items(spark, folder)
    empty = F.coalesce(F.col("defect") == "parse_error", F.lit(False))
    listed = F.when(empty, "").otherwise(F.col("item_json"))
    number = F.when(empty, "0").otherwise("1")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return items.select(
        F.concat(F.lit("c-"), F.concat_ws("-", *[F.col(c).cast("string") for c in key], F.date_format("l_shipdate", "yyyyMMdd"))).alias("id"),
        F.lit("cars_and_bids").alias("source"),
        F.lit("closed_auction_search").alias("target_type"),
        F.concat(F.lit("https://carsandbids.com/past-auctions/?q="), F.col("l_suppkey").cast("string")).alias("url"),
        F.lit("application/json").alias("content_type"),
        F.concat(F.lit('{"auctions":['), listed, F.lit('],"count":'), number, F.lit(',"total":'), number, F.lit("}")).alias("content"),
        F.col("l_shipdate").alias("fetched_at"),
    )


def detail_html(spark: SparkSession, folder: str) -> DataFrame:
    """One detail page per observation: bullets, JSON-LD, images, seller, bids."""
    df = described_observations(spark, folder)
    old = F.col("year") < 1981
    vin = F.rpad(F.upper(F.substring(F.sha1(F.col("source_auction_id")), 1, 12)), 17, "0")
    chassis = F.when(old, F.concat(F.lit("Chassis: ar"), F.col("l_partkey").cast("string"), F.lit(", Model#115"))).otherwise(
        F.concat(F.lit("Chassis: VIN: "), vin)
    )
    miles = F.when(
        F.col("mileage").isNotNull(), F.concat(F.lit("<li>"), F.format_number("mileage", 0), F.lit(" Miles Shown</li>"))
    ).otherwise("")
    bullets = F.concat(
        F.lit("<ul><li><b>"), chassis, F.lit("</b></li>"), miles,
        F.lit("<li>Factory &amp; spare fuel tank</li><li>"), F.col("exterior_color"), F.lit(" &ldquo;Metallic&rdquo; Paint</li>"),
        F.lit("<li>Owner's manual</li><li>"),
        F.when(F.col("l_returnflag") == "A", "Five-Speed Manual Transmission").otherwise("Automatic  Transaxle"),
        F.lit("</li><li>"), F.col("l_linenumber").cast("string"), F.lit(".0-Liter V8</li></ul>"),
    )
    product = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"WebPage"}</script><script type="application/ld+json">'),
        F.lit('[{"@type":"Product","description":"'), F.col("title"), F.lit('","image":"'),
        F.get("image_urls", F.lit(0)), F.lit('?w=1&amp;h=2"}]</script>'),
    )
    html = F.concat(
        F.lit("<html>"), product,
        F.lit('<div class="listing-intro-image big" id="x"><img class="a" src="https://b.example/wp-content/uploads/'),
        F.col("source_auction_id"), F.lit('.jpg?fit=1"><img src="https://b.example/logo.png"></div>'),
        F.lit('<div class="item item-seller"><strong>Seller</strong>: <a href="#">'), F.col("c_name"), F.lit("</a></div>"),
        F.lit('<strong>Location</strong>: <a href="#">'), F.col("n_name"), F.lit(" &amp; more</a>"),
        F.lit("<strong>Listing Details</strong>"), bullets,
        F.lit("<strong>Private Party or Dealer</strong>: "), F.col("c_mktsegment"),
        F.lit(" <strong>Lot</strong> #"), F.format_number("l_orderkey", 0),
        F.lit('<span class="number-bids-value">'), F.col("bid_count").cast("string"), F.lit("</span></html>"),
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "canonical_url", "year", html.alias("html"))
