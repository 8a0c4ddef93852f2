"""Data-quality rules. Every rule yields anomaly rows; `all_anomalies` unites them.

Codes, severities and message wording are fixed values of the anomaly table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions.maps import text_fragment
from lotledger.functions.urls import is_blocking
from lotledger.schemas import ANOMALY_FIELDS, DIRECTORY_URL, FIRST_SITE, SECOND_SITE, shaped

WARNING, CRITICAL = "warning", "critical"


def _fragment(column: Column, kind: str) -> Column:
    if kind == "string":
        return text_fragment(column)
    if kind.startswith(("map", "array", "struct")):
        return F.coalesce(F.to_json(column), F.lit("null"))
    return F.coalesce(column.cast("string"), F.lit("null"))


def _anomalies(
    rows: DataFrame, source: str | None, severity: str, code: str, message: Column, metadata: list[str]
) -> DataFrame:
    kinds = dict(rows.dtypes)
    notes = [part for name in metadata for part in (F.lit(name), _fragment(F.col(name), kinds[name]))]
    marked = rows.withColumns(
        {
            "_message": message,
            "_metadata": F.create_map(*notes).cast("map<string,string>") if notes
            else F.create_map().cast("map<string,string>"),
        }
    )
    named = marked.withColumns({"severity": F.lit(severity), "code": F.lit(code)})
    if source is not None:
        named = named.withColumn("source", F.lit(source))
    chosen = [c for c in ("run_id", "source", "severity", "code", "url", "created_at") if c in named.columns]
    return shaped(
        named.select(*chosen, F.col("_message").alias("message"), F.col("_metadata").alias("metadata")),
        ANOMALY_FIELDS,
    )


def pagination_incomplete(pages: DataFrame, mode: str = "incremental") -> DataFrame:
    """First pages of a result list of which not all pages will be read.

    `pages` has label, url, items_total, pages_total, page_current, parsed_first_page and
    page_limit.
    """
    rows = pages.where((F.col("pages_total") > 1) & (F.col("page_limit") < F.col("pages_total")))
    message = F.format_string(
        f"BaT page %s exposes %d completed-result pages; {mode} mode will parse %d pages.",
        "label", F.col("pages_total").cast("long"), F.col("page_limit").cast("long"),
    )
    return _anomalies(
        rows.withColumn("mode", F.lit(mode)), FIRST_SITE, WARNING, "bat_pagination_incomplete", message,
        ["items_total", "pages_total", "page_current", "parsed_first_page", "page_limit", "mode"],
    )


def pagination_without_filter(pages: DataFrame) -> DataFrame:
    """Result lists with more pages but without the filter that is needed to ask for them."""
    empty = F.coalesce("base_filter", F.lit("{}")).isin("{}", "null", "")
    message = F.format_string("BaT page %s has more pages but no base_filter metadata.", "label")
    return _anomalies(
        pages.where((F.col("pages_total") > 1) & empty), FIRST_SITE, CRITICAL,
        "bat_pagination_missing_filter", message, ["pages_total"],
    )


def nothing_parsed(tallies: DataFrame, source: str = FIRST_SITE) -> DataFrame:
    """Pages with items but without a new lot; the first site excuses pure duplicates."""
    empty = (F.col("raw_item_count") > 0) & (F.col("parsed_lot_count") == 0)
    if source == FIRST_SITE:
        rows = tallies.where(empty & (F.col("duplicate_count") == 0))
        message = F.concat(
            F.lit("BaT page "), F.col("page").cast("string"), F.lit(" returned raw items but parsed zero lots.")
        )
    else:
        rows = tallies.where(empty)
        message = F.lit("Cars & Bids returned raw auctions but parsed zero lots.")
    return _anomalies(rows, source, WARNING, "zero_parsed_lots", message, ["raw_item_count", "skip_counts"])


def no_response(tallies: DataFrame) -> DataFrame:
    """Searches of the second site that brought no item at all."""
    return _anomalies(
        tallies.where(F.col("raw_item_count") == 0), SECOND_SITE, CRITICAL, "no_closed_auction_response",
        F.lit("Cars & Bids returned no closed-auction API results."), ["page"],
    )


def empty_runs(counters: DataFrame) -> DataFrame:
    """Runs that found nothing; `counters` has run_id, source, mode and records_found."""
    message = F.concat("source", F.lit(" returned zero auction lots."))
    return _anomalies(counters.where(F.col("records_found") == 0), None, WARNING, "zero_lots", message, ["mode"])


def undetailed_run(undetailed: DataFrame) -> DataFrame:
    """First-site lots of a run that are stored without detail page (id, source)."""
    counted = undetailed.where(F.col("source") == FIRST_SITE).groupBy("source").agg(
        F.count(F.lit(1)).alias("missing_detail_count")
    )
    message = F.format_string(
        "%s has %d persisted lots from this run without detail enrichment.", "source", "missing_detail_count"
    )
    return _anomalies(counted, None, WARNING, "missing_detail_enrichment", message, ["missing_detail_count"])


def unreadable_items(rejects: DataFrame) -> DataFrame:
    """Items that could not be read (see the reject output of the list extraction)."""
    return _anomalies(
        rejects.where(F.col("skip_reason") == "parse_error"), FIRST_SITE, WARNING, "parse_error",
        F.lit("BaT completed-result item failed to parse."), ["title", "source_auction_id"],
    )


def unreadable_details(pages: DataFrame) -> DataFrame:
    """Detail pages with a bullet that could not be read."""
    message = F.concat(F.lit("BaT detail page failed to parse for "), F.col("url"), F.lit("; continuing."))
    return _anomalies(pages.where(F.col("detail_error")), FIRST_SITE, WARNING, "detail_parse_error", message, [])


def blocked_requests(requests: DataFrame) -> DataFrame:
    """Requests a site refused."""
    return _anomalies(
        requests.where(is_blocking(F.col("status_code"))), None, CRITICAL, "blocked_response",
        F.concat(F.lit("request refused by "), F.col("source")), ["status_code"],
    )


def empty_directory(entries: DataFrame) -> DataFrame:
    """One row when a model directory gave no entries."""
    counted = entries.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    return _anomalies(
        counted.withColumn("url", F.lit(DIRECTORY_URL)), FIRST_SITE, CRITICAL, "models_directory_empty",
        F.lit("BaT models directory returned no crawl targets."), [],
    )


def empty_directories(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Directory pages (raw_page_id, url) that gave no entry; `entries` names its `page`."""
    bare = pages.join(entries.select(F.col("page").alias("raw_page_id")), "raw_page_id", "left_anti")
    return _anomalies(
        bare, FIRST_SITE, CRITICAL, "models_directory_empty", F.lit("BaT models directory returned no crawl targets."), []
    )


def all_anomalies(*rules: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)
