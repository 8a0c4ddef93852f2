"""List items to lots: one projection per site, rejects kept with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions import images, sales, titles
from lotledger.functions.barriers import computed_once
from lotledger.functions.text import grouped_number, html_unescape
from lotledger.functions.variants import (
    as_text,
    filled_text,
    is_null,
    is_object,
    is_text,
    is_truthy,
    json_or_null,
    loose_number,
    member,
    plain_text,
    strict_number,
)
from lotledger.schemas import FIRST_SITE, RECORD_FIELDS, SECOND_SITE, SECOND_SITE_ROOT, packed

PARSE_ERROR = "parse_error"


def _with_fields(items: DataFrame, names: list[str]) -> DataFrame:
    """Every field once as its own VARIANT column, so later steps do not re-read the item."""
    return items.withColumns({f"_{n}": member(F.col("item"), n) for n in names})


def _values(names: list[str]) -> list[Column]:
    return [F.col(f"_{n}") for n in names]


def _finish(df: DataFrame, keep: list[str], reason: Column, lot: Column, names: list[str]) -> DataFrame:
    """The lot comes behind a barrier of its own, so a filter on the reason runs before any lot is put together.

    `names` are the fields that only the lot reads, each of them read once.
    """
    judged = _with_fields(computed_once(df, df.columns, skip_reason=reason), names)
    return computed_once(judged, [*keep, "skip_reason"], lot=F.when(F.col("skip_reason").isNull(), lot))


def first_site_lots(items: DataFrame) -> DataFrame:
    """Columns of `items` (VARIANT `item` among them) plus `skip_reason` and `lot`.

    Exactly one of the two is set. Reasons are tested in a fixed order: no_title,
    parts_or_non_car, no_url, no_year, no_price, no_end_date; a value of an unusable kind
    gives parse_error at the place where it is needed.
    """
    keep = items.columns
    df = _with_fields(items, ["title", "url", "sold_text", "current_bid", "timestamp_end"])
    df = df.withColumns(
        {
            "_name": as_text(F.col("_title")),
            "_link": filled_text(F.col("_url")),
            # An absent sale text counts as an empty one; any other kind is unusable.
            "_text": F.when(F.col("_sold_text").isNull(), "").otherwise(as_text(F.col("_sold_text"))),
            "_stamp": loose_number(F.col("_timestamp_end")),
            "_bid": loose_number(F.col("_current_bid")),
        }
    )
    df = df.withColumns(
        {
            "_readable": F.trim(html_unescape(F.col("_name"))),
            "_year": titles.model_year(F.col("_name")),
            "_tail": titles.after_year(F.col("_name")),
            "_digits": titles.title_mileage_digits(F.col("_name")),
            "_price_digits": sales.price_digits(F.col("_text")),
            "_date": sales.date_parts(F.col("_text")),
        }
    )
    df = df.withColumns(
        {
            "_non_car": titles.non_car_by_name(F.col("_readable")),
            "_price": grouped_number(F.col("_price_digits")),
            "_miles": titles.miles_of(F.col("_digits")),
            "_ended": F.coalesce(sales.end_time(F.col("_stamp")), sales.sale_date(F.col("_date"))),
            "_parts": titles.split_vehicle(F.col("_tail")),
        }
    )
    df = df.withColumn(
        "_identity", F.when(F.col("_year").isNotNull(), titles.make_model_trim(F.col("_parts")))
    )
    bad_price = F.col("_price_digits").isNotNull() & F.col("_price").isNull()
    bad_miles = titles.has_digits(F.col("_digits")) & F.col("_miles").isNull()
    reason = (
        F.when(~is_object(F.col("item")), PARSE_ERROR)
        .when(~is_truthy(F.col("_title")), "no_title")
        .when(~is_text(F.col("_title")), PARSE_ERROR)
        .when(F.col("_non_car"), "parts_or_non_car")
        .when(~is_truthy(F.col("_url")), "no_url")
        .when(F.col("_link").isNull(), PARSE_ERROR)
        .when(F.col("_year").isNull(), "no_year")
        .when(F.col("_text").isNull() | bad_price, PARSE_ERROR)
        .when(F.col("_price").isNull() | (F.col("_price") <= 0), "no_price")
        .when(F.col("_ended").isNull(), "no_end_date")
        .when(bad_miles, PARSE_ERROR)
    )
    lot = packed(
        RECORD_FIELDS,
        {
            "source": F.lit(FIRST_SITE),
            "source_auction_id": F.when(
                ~is_null(F.col("_id")), F.coalesce(F.try_variant_get(F.col("_id"), "$", "string"), F.to_json(F.col("_id")))
            ),
            "canonical_url": F.col("_link"),
            "auction_status": sales.text_status(F.col("_text")),
            "sold_price": F.when(sales.is_sold_text(F.col("_text")), F.col("_price")).try_cast("int"),
            "high_bid": F.coalesce(F.nullif(F.col("_bid"), F.lit(0).cast("long")), F.col("_price")).try_cast("int"),
            "bid_count": sales.first_bid_count(_values(sales.BID_COUNT_KEYS)).try_cast("int"),
            "currency": F.lit("USD"),
            "ended_at": F.col("_ended"),
            "year": F.col("_year"),
            "make": F.col("_identity.make"),
            "model": F.col("_identity.model"),
            "trim": F.col("_identity.trim"),
            "mileage": F.col("_miles"),
            "exterior_color": titles.color_name(F.col("_name")),
            "location": as_text(F.col("_country")),
            "title": F.col("_name"),
            "raw_summary": as_text(F.col("_excerpt")),
            "vehicle_details": F.create_map(
                F.lit("country"),
                json_or_null(F.col("_country")),
                F.lit("no_reserve"),
                is_truthy(F.col("_noreserve")).cast("string"),
            ),
            "list_payload": F.to_json(F.col("item")),
            "detail_payload": F.lit("{}"),
            "image_urls": images.item_images(_values(images.ITEM_KEYS), F.col("_images")),
        },
    )
    only_lot = ["id", "country", "excerpt", "noreserve", "images", *sales.BID_COUNT_KEYS, *images.ITEM_KEYS]
    return _finish(df, keep, reason, lot, only_lot)


def _leading_miles(text: Column) -> Column:
    digits = F.regexp_extract(F.trim(text), r"^[\d,]+", 0)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("int")


def _seller(value: Column) -> Column:
    named = F.coalesce(*[plain_text(member(value, k)) for k in ("username", "name", "display_name")])
    return F.when(is_object(value), named).otherwise(plain_text(value))


def second_site_lots(items: DataFrame, observed_at: Column) -> DataFrame:
    """As `first_site_lots`, for the second site's JSON items.

    `observed_at` is the end time of an item that tells none. Reasons in order: no_url,
    no_title, no_year, no_price.
    """
    keep = items.columns
    kept_details = ["engine", "drivetrain", "transmission", "location", "no_reserve", "seller"]
    df = _with_fields(
        items,
        ["id", "title", "sub_title", "status", "sale_amount", "current_bid", "mileage"],
    )
    df = df.withColumns(
        {
            "_key": plain_text(F.col("_id")),
            "_name": as_text(F.col("_title")),
            "_sub": filled_text(F.col("_sub_title")),
            "_state": sales.site_status(as_text(F.col("_status"))),
            "_sale": strict_number(F.col("_sale_amount")),
            "_bid": strict_number(F.col("_current_bid")),
        }
    )
    df = df.withColumns(
        {
            "_year": titles.model_year(F.col("_name")),
            "_high": F.coalesce(F.when(F.col("_bid") != 0, F.col("_bid")), F.col("_sale")),
            "_parts": titles.words_without_year(F.col("_name")),
        }
    )
    df = df.withColumn("_identity", titles.make_model_trim(F.col("_parts")))
    sold = F.col("_state") == sales.SOLD

    def missing(amount: str) -> Column:
        return F.col(amount).isNull() | (F.col(amount) <= 0)

    reason = (
        F.when(~is_object(F.col("item")), PARSE_ERROR)
        .when(~is_truthy(F.col("_id")), "no_url")
        .when(~is_truthy(F.col("_title")), "no_title")
        .when(F.col("_name").isNull() | F.col("_key").isNull(), PARSE_ERROR)
        .when(F.col("_year").isNull(), "no_year")
        .when(sold & missing("_sale"), "no_price")
        .when(missing("_high"), "no_price")
        .when(is_truthy(F.col("_mileage")) & ~is_text(F.col("_mileage")), PARSE_ERROR)
    )
    count_field = F.coalesce(
        *[F.when(is_truthy(F.col(c)), F.col(c)) for c in ("_bid_count", "_bids_count")],
        F.col("_num_bids"),
    )
    details = F.map_filter(
        F.create_map(
            *[
                part
                for k in kept_details
                for part in (F.lit(k), F.when(~is_null(F.col(f"_{k}")), F.to_json(F.col(f"_{k}"))))
            ]
        ),
        lambda _, value: value.isNotNull(),
    )
    lot = packed(
        RECORD_FIELDS,
        {
            "source": F.lit(SECOND_SITE),
            "source_auction_id": F.col("_key"),
            "canonical_url": F.concat(F.lit(f"{SECOND_SITE_ROOT}/auctions/"), F.col("_key"), F.lit("/")),
            "auction_status": F.col("_state"),
            "sold_price": F.when(sold, F.col("_sale")).try_cast("int"),
            "high_bid": F.col("_high").try_cast("int"),
            "bid_count": strict_number(count_field).try_cast("int"),
            "currency": F.lit("USD"),
            "ended_at": F.coalesce(sales.iso_end_time(as_text(F.col("_auction_end"))), observed_at),
            "year": F.col("_year"),
            "make": F.col("_identity.make"),
            "model": F.col("_identity.model"),
            "trim": F.col("_identity.trim"),
            "mileage": _leading_miles(as_text(F.col("_mileage"))),
            "exterior_color": titles.color_name(F.col("_sub")),
            "transmission": plain_text(F.col("_transmission")),
            "drivetrain": plain_text(F.col("_drivetrain")),
            "engine": plain_text(F.col("_engine")),
            "location": plain_text(F.col("_location")),
            "seller": _seller(F.col("_seller")),
            "title": F.col("_name"),
            "subtitle": F.col("_sub"),
            "raw_summary": F.col("_sub"),
            "vehicle_details": details,
            "list_payload": F.to_json(F.col("item")),
            "detail_payload": F.lit("{}"),
            "image_urls": images.photo_images(_values(images.PHOTO_KEYS), _values(images.PHOTO_LIST_KEYS)),
        },
    )
    only_lot = ["auction_end", "bid_count", "bids_count", "num_bids", *kept_details, *images.PHOTO_KEYS, *images.PHOTO_LIST_KEYS]
    return _finish(df, keep, reason, lot, only_lot)


def accepted(parsed: DataFrame) -> DataFrame:
    """Parsed lots as flat columns next to the carried ones."""
    carried = [c for c in parsed.columns if c not in ("item", "lot", "skip_reason")]
    return parsed.where(F.col("skip_reason").isNull()).select(*carried, "lot.*")


def rejected(parsed: DataFrame) -> DataFrame:
    """Items that gave no lot, with the reason and what identifies them."""
    carried = [c for c in parsed.columns if c not in ("item", "lot", "skip_reason")]
    return parsed.where(F.col("skip_reason").isNotNull()).select(
        *carried,
        "skip_reason",
        as_text(member(F.col("item"), "url")).alias("url"),
        as_text(member(F.col("item"), "title")).alias("title"),
        F.when(~is_null(member(F.col("item"), "id")), plain_text(member(F.col("item"), "id"))).alias(
            "source_auction_id"
        ),
        F.to_json(F.col("item")).alias("item_json"),
    )


