"""Column lists of the keyed and append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What one scraped record carries.
RECORD_FIELDS: dict[str, str] = {
    "source": "string",
    "source_auction_id": "string",
    "canonical_url": "string",
    "auction_status": "string",
    "sold_price": "int",
    "high_bid": "int",
    "bid_count": "int",
    "currency": "string",
    "listed_at": "timestamp",
    "ended_at": "timestamp",
    "year": "int",
    "make": "string",
    "model": "string",
    "trim": "string",
    "vin": "string",
    "mileage": "int",
    "exterior_color": "string",
    "interior_color": "string",
    "transmission": "string",
    "drivetrain": "string",
    "engine": "string",
    "body_style": "string",
    "location": "string",
    "seller": "string",
    "title": "string",
    "subtitle": "string",
    "raw_summary": "string",
    "vehicle_details": "map<string,string>",
    "list_payload": "string",
    "detail_payload": "string",
    "detail_html": "string",
    "detail_scraped_at": "timestamp",
    "image_urls": "array<string>",
}

# A record without a detail page never erases these on a lot that has one.
DETAIL_FIELDS = [
    "bid_count", "vin", "mileage", "exterior_color", "interior_color", "transmission",
    "drivetrain", "engine", "body_style", "location", "seller", "vehicle_details",
    "detail_payload", "detail_html", "detail_scraped_at",
]

LOT_FIELDS = {"id": "string", **RECORD_FIELDS, "created_at": "timestamp", "updated_at": "timestamp"}

RAW_PAGE_FIELDS: dict[str, str] = {
    "id": "string",
    "source": "string",
    "target_type": "string",
    "crawl_target_id": "string",
    "url": "string",
    "canonical_url": "string",
    "status_code": "int",
    "response_headers": "map<string,string>",
    "content": "string",
    "content_sha256": "string",
    "artifact_uri": "string",
    "content_type": "string",
    "size_bytes": "int",
    "fetched_at": "timestamp",
    "fetch_error": "string",
    "metadata": "map<string,string>",
    "created_at": "timestamp",
}

TARGET_FIELDS: dict[str, str] = {
    "id": "string",
    "source": "string",
    "target_type": "string",
    "url": "string",
    "canonical_url": "string",
    "request_method": "string",
    "request_fingerprint": "string",
    "state": "string",
    "priority": "int",
    "attempts": "int",
    "next_fetch_at": "timestamp",
    "last_error": "string",
    "discovered_from": "string",
    "metadata": "map<string,string>",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}

REQUEST_LOG_FIELDS: dict[str, str] = {
    "id": "string",
    "run_id": "string",
    "source": "string",
    "url": "string",
    "action": "string",
    "attempt": "int",
    "status_code": "int",
    "duration_ms": "int",
    "outcome": "string",
    "error_type": "string",
    "error_message": "string",
    "retry_delay_seconds": "double",
    "raw_item_count": "int",
    "parsed_lot_count": "int",
    "skip_counts": "map<string,int>",
    "metadata": "map<string,string>",
    "created_at": "timestamp",
}

ANOMALY_FIELDS: dict[str, str] = {
    "run_id": "string",
    "source": "string",
    "severity": "string",
    "code": "string",
    "message": "string",
    "url": "string",
    "metadata": "map<string,string>",
    "created_at": "timestamp",
}

RUN_FIELDS: dict[str, str] = {
    "id": "string",
    "source": "string",
    "mode": "string",
    "status": "string",
    "started_at": "timestamp",
    "finished_at": "timestamp",
    "records_found": "int",
    "records_inserted": "int",
    "records_updated": "int",
    "error": "string",
    "metadata": "map<string,string>",
}

# The sources, page types and their crawl priorities.
FIRST_SITE, SECOND_SITE = "bring_a_trailer", "cars_and_bids"
ACTIVE_SOURCES = [FIRST_SITE, SECOND_SITE]
DIRECTORY_PAGE, MODEL_PAGE = "bat_models_directory", "bat_model_page"
RESULTS_API, DETAIL_PAGE = "bat_api_completed_results", "bat_detail_page"
TARGET_PRIORITY = {DIRECTORY_PAGE: 10, MODEL_PAGE: 20, RESULTS_API: 30, DETAIL_PAGE: 80}
DEFAULT_PRIORITY = 100
SITE_ROOT = "https://bringatrailer.com"
DIRECTORY_URL = f"{SITE_ROOT}/models/"
RESULTS_URL = f"{SITE_ROOT}/wp-json/bringatrailer/1.0/data/listings-filter"
SECOND_SITE_ROOT = "https://carsandbids.com"
# End of fixed values.


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def shaped(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exactly these columns and types; missing ones are NULL."""
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in fields.items()
        ]
    )


def packed(fields: dict[str, str], values: dict[str, Column]) -> Column:
    """Struct with these fields; missing ones are NULL."""
    return F.struct(
        *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()]
    )


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def camel_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with camelCase names and explicit nulls."""
    renamed = df.toDF(*[camel(name) for name in df.columns])
    return renamed.select(
        F.to_json(F.struct(*renamed.columns), {"ignoreNullFields": "false"}).alias("json")
    )
