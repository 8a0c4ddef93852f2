"""The given tables read as auction data.

lineitem rows are observations of lots: (l_orderkey, l_linenumber) repeats, and the latest
observation is the current state of the lot. Orders, parts, customers and nations describe
it; events are request logs, orders double as crawl runs, pages are fetched raw pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.functions.keys import batch_key, lot_id
from lotledger.schemas import FIRST_SITE, SECOND_SITE

LISTING_ROOT = "https://auctions.example/listing/"
KEY = ["l_orderkey", "l_linenumber"]
AGE = ["l_shipdate", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def site_of(number: Column) -> Column:
    return F.when(number % 2 == 0, FIRST_SITE).otherwise(SECOND_SITE)


def latest_lineitems(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Latest observation per lot; only the asked columns take part.

    The maximum of a struct is combined on the map side, so a lot that was observed very
    often costs one row per task.
    """
    rows = table(spark, folder, "lineitem")
    extra = [c for c in columns if c not in KEY + AGE]
    newest = rows.groupBy(*KEY).agg(F.max(F.struct(*AGE, *extra)).alias("_r"))
    return newest.select(*KEY, *[F.col(f"_r.{c}").alias(c) for c in AGE + extra])


def describe(rows: DataFrame, spark: SparkSession, folder: str, *, vehicle: bool, place: bool) -> DataFrame:
    """Joins what the lot is (part) and where it is (customer's nation) as needed."""
    orders = table(spark, folder, "orders")
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if vehicle:
        joined = joined.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if place:
        joined = joined.join(
            table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
        ).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined


def lot_columns(vehicle: bool, place: bool) -> dict[str, Column]:
    """Lot columns over a described observation."""
    status = F.col("o_orderstatus")
    auction_status = (
        F.when(status == "F", "sold").when(status == "O", "reserve_not_met").otherwise("withdrawn")
    )
    amount = F.floor("l_extendedprice").cast("int")
    source = site_of(F.col("l_orderkey"))
    auction_id = F.concat_ws("-", *KEY)
    url = F.concat(F.lit(LISTING_ROOT), auction_id, F.lit("/"))
    columns = {
        "id": lot_id(batch_key(source, auction_id, url)),
        "source": source,
        "source_auction_id": auction_id,
        "canonical_url": url,
        "auction_status": auction_status,
        "sold_price": F.when(status == "F", amount),
        "high_bid": amount,
        "bid_count": F.col("l_quantity").cast("int"),
        "currency": F.lit("USD"),
        "listed_at": F.col("o_orderdate"),
        "ended_at": F.col("l_shipdate"),
        "mileage": F.when(F.col("l_tax") < 0.07, (F.col("l_quantity") * 1000).cast("int")),
        "transmission": F.col("l_returnflag"),
        "subtitle": F.lit(None).cast("string"),
        "image_urls": F.array(
            F.concat(F.lit("https://img.example/p/"), F.col("l_partkey").cast("string")),
            F.concat(F.lit("https://img.example/s/"), F.col("l_suppkey").cast("string")),
        ),
        "detail_scraped_at": F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")),
        "created_at": F.col("o_orderdate"),
    }
    if vehicle:
        year = F.col("p_size") + 1975
        columns |= {
            "year": year,
            "make": F.col("p_brand"),
            "model": F.col("p_type"),
            "trim": F.col("p_name"),
            "exterior_color": F.substring_index("p_name", " ", 1),
            "title": F.concat_ws(" ", year.cast("string"), "p_brand", "p_type", "p_name"),
        }
    if place:
        columns["location"] = F.col("n_name")
    return columns


def observations(
    spark: SparkSession, folder: str, *, vehicle: bool = True, place: bool = False
) -> DataFrame:
    """All observations as lot records, with their order in `seen` (a struct)."""
    rows = describe(table(spark, folder, "lineitem"), spark, folder, vehicle=vehicle, place=place)
    columns = lot_columns(vehicle, place)
    return rows.select(F.struct(*AGE).alias("seen"), *[c.alias(n) for n, c in columns.items()])


def lots(
    spark: SparkSession, folder: str, *, vehicle: bool = True, place: bool = False
) -> DataFrame:
    """The keyed lot table."""
    rows = latest_lineitems(
        spark, folder, "l_extendedprice", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"
    )
    described = describe(rows, spark, folder, vehicle=vehicle, place=place)
    return described.select(*[c.alias(n) for n, c in lot_columns(vehicle, place).items()])


def request_logs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "error", "error")
        .when(kind == "view", "success")
        .when(kind == "click", "retry")
        .when(kind == "purchase", "skipped")
        .otherwise("blocked")
    )
    status = (
        F.when(kind == "error", 404)
        .when(kind == "view", 200)
        .when(kind == "click", 503)
        .when(kind == "signup", 429)
    )
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("run_id"),
        site_of(F.col("user_id")).alias("source"),
        F.concat(F.lit(LISTING_ROOT), F.col("event_id").cast("string")).alias("url"),
        F.lit("http_get").alias("action"),
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt"),
        status.alias("status_code"),
        F.floor("value").cast("int").alias("duration_ms"),
        outcome.alias("outcome"),
        F.from_json("props", "map<string,string>").alias("metadata"),
        F.col("ts").alias("created_at"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        site_of(F.col("o_custkey")).alias("source"),
        F.lit("incremental").alias("mode"),
        F.when(status == "F", "success").when(status == "O", "running").otherwise("error").alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.when(status != "O", F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        F.floor("o_totalprice").cast("int").alias("records_found"),
        F.floor(F.col("o_totalprice") / 10).cast("int").alias("records_inserted"),
        F.floor(F.col("o_totalprice") / 20).cast("int").alias("records_updated"),
        F.when(status == "P", F.col("o_orderpriority")).alias("error"),
    )


def anomalies(logs: DataFrame) -> DataFrame:
    """Refused requests of a log as stored anomalies."""
    return logs.where(F.col("outcome").isin("blocked", "error")).select(
        "id",
        "run_id",
        "source",
        F.when(F.col("outcome") == "blocked", "critical").otherwise("warning").alias("severity"),
        F.when(F.col("outcome") == "blocked", "blocked_response").otherwise("request_error").alias("code"),
        F.concat(F.lit("request "), "id").alias("message"),
        "url",
        "created_at",
    )


def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as they come from the network, one day of January 2024 each."""
    number = F.col("page_id")
    day = F.make_timestamp_ntz(
        F.lit(2024), F.lit(1), (number % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)
    )
    return table(spark, folder, "pages").select(
        number.cast("string").alias("id"),
        site_of(number).alias("source"),
        F.when(number % 3 == 0, "bat_model_page").otherwise("bat_detail_page").alias("target_type"),
        "url",
        F.when(number % 10 == 0, 429).otherwise(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("content"),
        day.alias("fetched_at"),
        day.alias("created_at"),
    )


def discovered_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Every page URL as a found crawl target, once as it is and once with a slash added."""
    pages = fetched_pages(spark, folder)
    number = F.col("id").cast("long")
    shapes = F.array(
        F.struct(F.lit(0).alias("turn"), F.col("url").alias("found")),
        F.struct(
            F.lit(1).alias("turn"),
            F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/")).alias("found"),
        ),
    )
    found = pages.withColumn("_s", F.explode(shapes))
    return found.select(
        "source",
        "target_type",
        F.col("_s.found").alias("url"),
        F.when(F.col("_s.turn") == 0, 80).otherwise(20).alias("priority"),
        F.col("id").alias("discovered_from"),
        F.create_map(
            F.concat(F.lit("turn_"), F.col("_s.turn").cast("string")), F.col("id"), F.lit("last"), F.col("id")
        ).alias("metadata"),
        (number * 2 + F.col("_s.turn")).alias("ord"),
    )



def target_tries(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a landed page: one try to fetch the target of its user, with the answer the event tells of."""
    kind, listing = F.col("event_type"), F.col("user_id").cast("string")
    status = F.when(kind == "error", 404).when(kind == "view", 200).when(kind == "click", 503).when(kind == "signup", 429)
    wait = ((F.col("event_id") % 3 + 1) * 60).cast("string")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        site_of(F.col("user_id")).alias("source"),
        F.lit("bat_detail_page").alias("target_type"),
        F.concat(F.lit(LISTING_ROOT), listing).alias("url"),
        status.alias("status_code"),
        F.when(status.isNull(), "timed out").alias("fetch_error"),
        F.create_map(F.lit("retry_delay_seconds"), wait).alias("metadata"),
        F.col("ts").alias("fetched_at"),
        F.col("ts").alias("created_at"),
    )


def customer_targets(spark: SparkSession, folder: str) -> DataFrame:
    """A detail page to fetch for every customer, as a found target; events of the customer's number are its tries."""
    return table(spark, folder, "customer").select(
        site_of(F.col("c_custkey")).alias("source"),
        F.lit("bat_detail_page").alias("target_type"),
        F.concat(F.lit(LISTING_ROOT), F.col("c_custkey").cast("string"), F.lit("/")).alias("url"),
        F.lit(80).alias("priority"),
        F.lit(None).cast("string").alias("discovered_from"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col("c_custkey").alias("ord"),
    )
