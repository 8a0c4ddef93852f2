"""Crawl targets: discovery, deduplication by fingerprint, state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions.maps import empty_map, entries_to_map, last_entries, merged, text_fragment
from lotledger.functions.urls import canonical_url, is_blocking, request_fingerprint
from lotledger.schemas import (
    DETAIL_PAGE,
    FIRST_SITE,
    MODEL_PAGE,
    RESULTS_API,
    RESULTS_URL,
    SITE_ROOT,
    TARGET_FIELDS,
    TARGET_PRIORITY,
    shaped,
)


def with_fingerprint(found: DataFrame) -> DataFrame:
    """Adds canonical_url, request_method and request_fingerprint to discovered targets."""
    method = F.upper("request_method") if "request_method" in found.columns else F.lit("GET")
    payload = F.try_element_at(F.col("metadata"), F.lit("request_payload"))
    return found.withColumns(
        {
            "canonical_url": canonical_url(F.col("url")),
            "request_method": method,
            "request_fingerprint": request_fingerprint(
                F.col("source"), F.col("target_type"), F.col("url"), method, payload
            ),
        }
    )


def fold_targets(found: DataFrame, order: str = "ord") -> DataFrame:
    """One row per fingerprint: lowest priority, first discovery, metadata where the last wins."""
    keyed = with_fingerprint(found)
    first = F.struct("source", "target_type", "url", "canonical_url", "request_method", "discovered_from")
    folded = keyed.groupBy("request_fingerprint").agg(
        F.min("priority").alias("priority"), F.min_by(first, order).alias("_first")
    )
    entries = last_entries(keyed, ["request_fingerprint"], "metadata", order)
    return folded.join(entries, "request_fingerprint", "left").select(
        "request_fingerprint",
        "_first.*",
        "priority",
        F.coalesce(entries_to_map(F.col("metadata")), empty_map()).alias("metadata"),
    )


def enqueue(existing: DataFrame, found: DataFrame, now: Column, order: str = "ord") -> DataFrame:
    """New and touched targets after discoveries, with `is_new`.

    A known target keeps its state and first discovery; its priority can only become more
    urgent and its metadata is extended. Targets nobody found again are not rewritten.
    """
    folded = fold_targets(found, order)
    known = existing.select(
        "request_fingerprint", *[F.col(c).alias(f"_{c}") for c in TARGET_FIELDS if c != "request_fingerprint"]
    )
    joined = folded.join(known, "request_fingerprint", "left")
    is_new = F.col("_id").isNull()
    kept = ["source", "target_type", "url", "canonical_url", "request_method", "discovered_from"]
    return joined.select(
        F.coalesce("_id", "request_fingerprint").alias("id"),
        *[F.when(is_new, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in kept],
        "request_fingerprint",
        F.coalesce("_state", F.lit("pending")).alias("state"),
        F.least("priority", "_priority").cast("int").alias("priority"),
        F.coalesce("_attempts", F.lit(0)).alias("attempts"),
        F.col("_next_fetch_at").alias("next_fetch_at"),
        F.col("_last_error").alias("last_error"),
        merged(F.col("_metadata"), F.col("metadata")).alias("metadata"),
        F.coalesce("_created_at", now).alias("created_at"),
        now.alias("updated_at"),
        is_new.alias("is_new"),
    )


def after_enqueue(existing: DataFrame, touched: DataFrame) -> DataFrame:
    """The whole target table once touched targets are put in place."""
    rest = existing.join(touched.select("request_fingerprint"), "request_fingerprint", "left_anti")
    return shaped(rest, TARGET_FIELDS).unionByName(shaped(touched, TARGET_FIELDS))


def fetch_events(pages: DataFrame) -> DataFrame:
    """One transition per landed page: target_id, ord, event, error, raw_page_id and retry_at.

    A page names its target (`crawl_target_id`) or is the answer to the request with its fingerprint. Refused requests
    block the target. No answer and server errors may be tried again, from `retry_delay_seconds` of the page's metadata
    on where it is told; other errors are final.
    """
    note = lambda name: F.try_element_at(F.col("metadata"), F.lit(name))
    status, broken = F.col("status_code"), F.nullif(F.col("fetch_error"), F.lit(""))
    method = F.coalesce(note("request_method"), F.lit("GET"))
    fingerprint = request_fingerprint(F.col("source"), F.col("target_type"), F.col("url"), method, note("request_payload"))
    event = (
        F.when(is_blocking(status), "blocked")
        .when(status >= 500, "failed_retryable")
        .when(status >= 400, "failed")
        .when(broken.isNotNull(), "failed_retryable")
        .otherwise("fetched")
    )
    site = F.when(F.col("source") == FIRST_SITE, "BaT").otherwise(F.col("source"))
    told = pages.select(
        F.coalesce("crawl_target_id", fingerprint).alias("target_id"),
        F.struct("fetched_at", "id").alias("ord"),
        event.alias("event"),
        F.coalesce(broken, F.when(status >= 400, F.concat(site, F.lit(" returned "), status.cast("string")))).alias("error"),
        F.col("id").alias("raw_page_id"),
        (F.col("fetched_at") + F.make_dt_interval(secs=note("retry_delay_seconds").cast("decimal(18,6)"))).alias("_later"),
    )
    again = F.when(F.col("event") == "failed_retryable", F.col("_later").cast("timestamp"))
    return told.withColumn("retry_at", again).drop("_later")


def current_state(targets: DataFrame, events: DataFrame) -> DataFrame:
    """Targets after their latest transition.

    `events` (target_id, ord, event, error, raw_page_id, maybe retry_at): fetched; failed_retryable (back to
    pending, until retry_at), failed (error) and blocked. Appending events and reading the latest one takes
    the place of updating rows. Events of unknown targets change nothing.
    """
    state = (
        F.when(F.col("event") == "fetched", "fetched")
        .when(F.col("event") == "failed_retryable", "pending")
        .when(F.col("event") == "failed", "error")
        .when(F.col("event") == "blocked", "blocked")
    )
    fetched_page = F.max_by("raw_page_id", F.when(F.col("event") == "fetched", F.col("ord")))
    retry = F.col("retry_at") if "retry_at" in events.columns else F.lit(None).cast("timestamp")
    last = events.withColumns({"_to": state, "_at": retry}).groupBy(F.col("target_id").alias("id")).agg(
        F.max_by("_to", "ord").alias("_state"),
        F.max_by("_at", "ord").alias("_retry"),
        F.max_by("error", F.when(F.col("event") != "fetched", F.col("ord"))).alias("_error"),
        fetched_page.alias("_page"),
        F.count(F.lit(1)).cast("int").alias("_tries"),
    )
    page_note = F.when(
        F.col("_page").isNotNull(), F.create_map(F.lit("raw_page_id"), text_fragment(F.col("_page")))
    )
    joined = targets.join(last, "id", "left")
    return joined.withColumns(
        {
            "state": F.coalesce("_state", "state"),
            "next_fetch_at": F.when(F.col("_state").isNull(), F.col("next_fetch_at")).otherwise(F.col("_retry")),
            "last_error": F.coalesce("_error", "last_error"),
            "attempts": (F.coalesce("attempts", F.lit(0)) + F.coalesce("_tries", F.lit(0))).cast("int"),
            "metadata": merged(F.col("metadata"), page_note),
        }
    ).drop("_state", "_retry", "_error", "_page", "_tries")


def detail_targets(lots: DataFrame) -> DataFrame:
    """Detail pages of listed lots (raw_page_id and ord may tell where they were found)."""
    return lots.select(
        F.lit(FIRST_SITE).alias("source"),
        F.lit(DETAIL_PAGE).alias("target_type"),
        F.col("canonical_url").alias("url"),
        F.lit(TARGET_PRIORITY[DETAIL_PAGE]).alias("priority"),
        (F.col("raw_page_id") if "raw_page_id" in lots.columns else F.lit(None).cast("string")).alias(
            "discovered_from"
        ),
        F.create_map(
            F.lit("source_auction_id"), text_fragment(F.col("source_auction_id")),
            F.lit("title"), text_fragment(F.col("title")),
        ).alias("metadata"),
        "ord",
    )


def result_page_targets(pages: DataFrame) -> DataFrame:
    """Pages 2 to the last one of a result list, when its filter is known.

    `pages` has raw_page_id, url, base_filter (JSON text), pages_total, items_per_page and ord.
    """
    usable = ~F.coalesce("base_filter", F.lit("{}")).isin("{}", "null", "")
    more = pages.where(usable & (F.col("pages_total") > 1)).withColumn(
        "_page", F.explode(F.sequence(F.lit(2).cast("long"), F.col("pages_total").cast("long")))
    )
    payload = F.concat(
        F.lit('{"base_filter":'), F.col("base_filter"),
        F.lit(',"page":'), F.col("_page").cast("string"),
        F.lit(',"per_page":'), F.coalesce("items_per_page", F.lit(24)).cast("string"),
        F.lit(',"referer_url":'), text_fragment(F.col("url")), F.lit("}"),
    )
    return more.select(
        F.lit(FIRST_SITE).alias("source"),
        F.lit(RESULTS_API).alias("target_type"),
        F.lit(RESULTS_URL).alias("url"),
        F.lit(TARGET_PRIORITY[RESULTS_API]).alias("priority"),
        F.col("raw_page_id").alias("discovered_from"),
        F.create_map(F.lit("request_payload"), payload).alias("metadata"),
        "ord",
    )


def page_limit(pages_total: Column, mode: str, limit: int) -> Column:
    """All pages when reading history, the first `limit` otherwise."""
    return pages_total if mode == "backfill" else F.least(pages_total, F.lit(limit).cast("int"))


def seed_targets(entries: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Model or make pages as targets; `entries` has key, label, path and ord."""
    chosen = entries if selected is None else entries.where(F.col("key").isin(selected))
    path = F.btrim(F.col("path"), F.lit("/"))
    return chosen.select(
        F.lit(FIRST_SITE).alias("source"),
        F.lit(MODEL_PAGE).alias("target_type"),
        F.concat(F.lit(f"{SITE_ROOT}/"), path, F.lit("/")).alias("url"),
        F.lit(TARGET_PRIORITY[MODEL_PAGE]).alias("priority"),
        F.lit(None).cast("string").alias("discovered_from"),
        F.create_map(
            *[part for c in ("key", "label", "path") for part in (F.lit(c), text_fragment(F.col(c)))]
        ).alias("metadata"),
        "ord",
    )
