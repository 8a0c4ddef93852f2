"""Parsing stored raw pages: new ones in a stream, or any number of old ones again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.operators import detail_pages, list_items, provenance, quality, tallies, targets, upsert
from lotledger.plans.runs import RunContext
from lotledger.schemas import DETAIL_PAGE, DIRECTORY_PAGE, FIRST_SITE, RECORD_FIELDS, SECOND_SITE, TARGET_FIELDS
from lotledger.sources.listing_pages import exploded_items, with_paging, with_payload

# Parser names and versions of the parse-run record.
LIST_PARSER = ("bat_completed_results", "bat-list-raw-v1")
DETAIL_PARSER = ("bat_detail_page", "bat-detail-raw-v1")
# End of fixed values.

ANSWER_PARSER = ("captured_auctions", "captured-auctions-v1")  # the second site's answers

# What parsing reads of a loaded page beside its items.
PAGE_COLUMNS = [
    "raw_page_id", "source", "url", "fetched_at", "readable", "is_json", "items_total", "items_per_page", "page_current", "pages_total",
    "base_filter",
]

COUNTS = ["records_found", "records_inserted", "records_updated", "targets_discovered"]


@dataclass(frozen=True)
class Parsed:
    """What a set of pages yields, before it is written anywhere."""

    lots: DataFrame
    links: DataFrame
    targets: DataFrame
    parse_runs: DataFrame
    rejects: DataFrame
    conflicts: DataFrame
    anomalies: DataFrame


def answered(pages: DataFrame) -> DataFrame:
    """Pages that hold what was asked for: refused and failed requests are stored, but never parsed."""
    good = F.coalesce(F.col("status_code") < 400, F.lit(True))
    return pages.where(good & (F.coalesce("fetch_error", F.lit("")) == ""))


def list_pages(pages: DataFrame) -> DataFrame:
    """Result pages of the first site and answers of the second."""
    return answered(pages).where(F.col("source").isin(FIRST_SITE, SECOND_SITE) & (F.col("target_type") != DETAIL_PAGE))


def detail_pages_of(pages: DataFrame) -> DataFrame:
    return answered(pages).where((F.col("source") == FIRST_SITE) & (F.col("target_type") == DETAIL_PAGE))


def directory_pages(pages: DataFrame) -> DataFrame:
    return answered(pages).where((F.col("source") == FIRST_SITE) & (F.col("target_type") == DIRECTORY_PAGE))


def _page_order(position: Column) -> Column:
    return F.struct(F.col("fetched_at"), F.col("raw_page_id"), position.cast("int").alias("pos"))


def _parse_runs(pages: DataFrame, parser: tuple[str, str], version: str | None, counts: DataFrame, failed: Column, now: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    second = F.col("source") == SECOND_SITE
    return pages.join(counts, "raw_page_id", "left").select(
        "raw_page_id",
        F.when(second, ANSWER_PARSER[0]).otherwise(parser[0]).alias("parser_name"),
        F.lit(version).alias("parser_version") if version else F.when(second, ANSWER_PARSER[1]).otherwise(parser[1]).alias("parser_version"),
        F.when(failed, "error").otherwise("success").alias("status"),
        *[F.coalesce(F.col(c) if c in counts.columns else zero, zero).alias(c) for c in COUNTS],
        now.alias("finished_at"),
    )


def load_list_pages(pages: DataFrame) -> DataFrame:
    """Result pages with paging data and `readable` (false for a JSON page that is none)."""
    loaded = with_paging(with_payload(list_pages(pages).withColumnRenamed("id", "raw_page_id")))
    return loaded.withColumn("readable", ~(F.col("is_json") & F.col("payload").isNull()))


def parse_items(loaded: DataFrame, with_pages: bool = False) -> DataFrame:
    """The items of loaded pages of both sites (`site`), each as a lot or with its skip reason.

    An item of the second site that tells no end time ended when its page was fetched. `with_pages` keeps what is read of the
    pages in `page_row`, and a row without `pos` for a page that has no item (see `pages_and_items`).
    """
    known = [F.struct(*PAGE_COLUMNS).alias("page_row")] if with_pages else []
    carried = loaded.select("raw_page_id", "fetched_at", F.col("source").alias("site"), "payload", *known)
    items = exploded_items(carried, "site", outer=with_pages)
    first = list_items.first_site_lots(items.where(F.col("site") == FIRST_SITE))
    second = list_items.second_site_lots(items.where(F.col("site") == SECOND_SITE), F.col("fetched_at"))
    return first.unionByName(second)


def pages_and_items(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The loaded pages (PAGE_COLUMNS) and the parsed items out of one table of both."""
    pages = parsed.where(F.col("pos").isNull() | (F.col("pos") == 0)).select("page_row.*")
    return pages, parsed.where(F.col("pos").isNotNull()).drop("page_row")


def page_anomalies(loaded: DataFrame, parsed: DataFrame, run: RunContext | None = None) -> DataFrame:
    """Result pages that gave no lot, answers of the second site without any item and, if the run is known, lists that it will not read to their end.

    Without a run each stored page is a run of its own; with one, a lot counts for the first page of the run that lists it.
    """
    own = F.col("raw_page_id") if run is None else F.lit(run.run_id)
    paging = ["items_total", "pages_total", "page_current", "base_filter", "is_json"]
    pages = loaded.where("readable").select(own.alias("run_id"), F.col("raw_page_id").alias("page"), "url", "source", *paging)
    items = parsed.select(
        own.alias("run_id"), F.col("raw_page_id").alias("page"), _page_order(F.col("pos")).alias("ord"), "skip_reason",
        F.col("lot.canonical_url").alias("canonical_url"),
    ).join(pages.select("page"), "page", "left_semi")
    tally = tallies.page_tally(items, pages).join(pages, ["run_id", "page"]).withColumn("page", F.col("url"))
    first, second = (tally.where(F.col("source") == site).drop("source") for site in (FIRST_SITE, SECOND_SITE))
    rules = [quality.nothing_parsed(first), quality.nothing_parsed(second, SECOND_SITE), quality.no_response(second)]
    if run is not None:
        # Pages of the API continue a list that was judged by its first page.
        lists = first.where(~F.col("is_json")).withColumns(
            {
                "label": F.col("url"),
                "parsed_first_page": F.col("parsed_lot_count"),
                "page_limit": targets.page_limit(F.col("pages_total"), run.mode, run.page_limit),
            }
        )
        rules += [quality.pagination_incomplete(lists, run.mode), quality.pagination_without_filter(lists)]
    return quality.all_anomalies(*rules)


def parse_list_pages(
    loaded: DataFrame, parsed: DataFrame, lots: DataFrame, known_links: DataFrame, known_targets: DataFrame,
    now: Column, version: str | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    run: RunContext | None = None,
) -> Parsed:
    """Result pages to lots, links, detail targets and the targets of the remaining pages.

    `loaded` and `parsed` come from `load_list_pages` and `parse_items`; a job that writes
    several of the results keeps them in between, so that no page is parsed twice, and stores the identities with `keep`.
    """
    records = list_items.accepted(parsed).withColumn("ord", _page_order(F.col("pos")))
    merged = upsert.upsert_lots(lots, records.select(*RECORD_FIELDS, "ord"), now, keep=keep)

    # Each page's distinct identities: a lot with very many records costs one row per page.
    placed = records.select("raw_page_id", *upsert.RAW_KEY).distinct().join(
        merged.identities.withColumnRenamed("source_auction_id", "_id"),
        ["source", "canonical_url"],
    ).where(F.col("_id").eqNullSafe(F.nullif(F.col("source_auction_id"), F.lit(""))))
    links = placed.select("raw_page_id", "lot_id", F.lit("list").alias("relationship_type"))

    # Only the first site's lots have detail pages to fetch, only its lists go on over numbered pages.
    first = loaded.where(F.col("source") == FIRST_SITE)
    found = targets.detail_targets(records.where(F.col("source") == FIRST_SITE)).unionByName(
        targets.result_page_targets(first.withColumn("ord", _page_order(F.lit(1_000_000_000))))
    )
    queued = targets.enqueue(known_targets, found, now)

    by_page = records.withColumn("run_id", F.col("raw_page_id"))
    counters = upsert.run_counters(by_page, merged.identities, lots).withColumnRenamed("run_id", "raw_page_id")
    discovered = queued.where("is_new").groupBy(F.col("discovered_from").alias("raw_page_id")).agg(
        F.count(F.lit(1)).alias("targets_discovered")
    )
    counts = counters.join(discovered, "raw_page_id", "full")
    rejects = list_items.rejected(parsed)
    return Parsed(
        lots=merged.lots,
        links=provenance.missing_links(known_links, links),
        targets=queued,
        parse_runs=_parse_runs(
            loaded.select("raw_page_id", "source", "readable"), LIST_PARSER, version, counts, ~F.col("readable"), now
        ),
        rejects=rejects,
        conflicts=merged.conflicts,
        anomalies=quality.all_anomalies(quality.unreadable_items(rejects.where(F.col("site") == FIRST_SITE)), page_anomalies(loaded, parsed, run)),
    )


def read_detail_pages(pages: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched detail pages with their payload, pages that fit several lots)."""
    matched, ambiguous = provenance.match_detail_pages(detail_pages_of(pages), lots)
    page_columns = matched.select(
        F.col("id").alias("raw_page_id"), "lot_id", "fetched_at", F.col("content").alias("html"),
        F.col("url").alias("page_url"),
    )
    rejects = ambiguous.select(
        F.col("id").alias("raw_page_id"), "url", F.lit("fits_several_lots").alias("skip_reason")
    )
    return detail_pages.detail_payload(page_columns), rejects


def parse_detail_pages(
    pages: DataFrame, read: DataFrame, rejects: DataFrame, lots: DataFrame, known_links: DataFrame, now: Column,
    version: str | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Parsed:
    """Detail pages onto the stored lots they belong to (`read` from `read_detail_pages`)."""
    together = read.join(lots.select(F.col("id").alias("lot_id"), *RECORD_FIELDS), "lot_id")
    enriched = detail_pages.enriched_lots(together)
    records = enriched.withColumn("ord", _page_order(F.lit(0)))
    merged = upsert.upsert_lots(lots, records.select(*RECORD_FIELDS, "ord"), now, keep=keep)
    links = records.select("raw_page_id", "lot_id", F.lit("detail").alias("relationship_type"))
    counts = records.groupBy("raw_page_id").agg(
        F.count(F.lit(1)).alias("records_found"), F.count(F.lit(1)).alias("records_updated")
    )
    # A page with an unreadable bullet, or one that fits several lots, is an error.
    unread = read.where("detail_error").select("raw_page_id").union(rejects.select("raw_page_id")).distinct()
    failed = unread.withColumn("_failed", F.lit(True))
    shown = detail_pages_of(pages).select(F.col("id").alias("raw_page_id"), "source").join(failed, "raw_page_id", "left")
    spark = pages.sparkSession
    no_targets = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in TARGET_FIELDS.items()))
    return Parsed(
        lots=merged.lots,
        links=provenance.missing_links(known_links, links),
        targets=no_targets.withColumn("is_new", F.lit(True)),
        parse_runs=_parse_runs(
            shown, DETAIL_PARSER, version, counts, F.coalesce("_failed", F.lit(False)), now
        ),
        rejects=rejects,
        conflicts=merged.conflicts,
        anomalies=quality.unreadable_details(read.withColumnRenamed("page_url", "url")),
    )


def outcome_totals(parse_runs: DataFrame) -> DataFrame:
    """Found, inserted, updated and discovered over a replay, with failed pages."""
    return parse_runs.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("status") == "error", True)).alias("failed_pages"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
