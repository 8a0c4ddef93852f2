"""First-seen lots, per-page tallies, crawl-state snapshots and progress counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.functions.maps import text_fragment


def first_seen(lots: DataFrame, run: str = "run_id", order: str = "ord") -> DataFrame:
    """The first record of every url within a run; `order` tells what came first."""
    rest = [c for c in lots.columns if c not in (run, "canonical_url")]
    first = lots.groupBy(run, "canonical_url").agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(run, "canonical_url", *[F.col(f"_first.{c}").alias(c) for c in rest])


def page_tally(items: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per page: raw items, new lots, duplicates within the run and skips by reason.

    `items` has run_id, page, ord, skip_reason and canonical_url (NULL when skipped). With `pages` (run_id, page, each once) a page
    that holds no item has a row of zeros.
    """
    page, parsed, counted = ["run_id", "page"], F.col("skip_reason").isNull(), F.col("_counted")
    nothing = lambda c: F.when(F.lit(False), F.col(c))
    # Every item counts for its page and, if it is parsed, asks for the first page of its url: one pass for both, as
    # a second one would parse all items again.
    of_page = F.struct(
        F.lit(True).alias("_counted"), F.col("page").alias("page"), F.col("skip_reason").alias("skip_reason"),
        nothing("canonical_url").alias("canonical_url"), nothing("page").alias("_page"), nothing("ord").alias("ord"),
    )
    of_url = F.struct(
        F.lit(False).alias("_counted"), nothing("page").alias("page"), nothing("skip_reason").alias("skip_reason"),
        F.col("canonical_url").alias("canonical_url"), F.col("page").alias("_page"), F.col("ord").alias("ord"),
    )
    told = items.select("run_id", F.inline(F.when(parsed, F.array(of_page, of_url)).otherwise(F.array(of_page))))
    by_key = told.groupBy("run_id", "_counted", "page", "skip_reason", "canonical_url").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_page", "ord").alias("_first")
    )
    skipped = counted & F.col("skip_reason").isNotNull()
    by_page = by_key.withColumn("page", F.when(counted, F.col("page")).otherwise(F.col("_first"))).groupBy(*page).agg(
        F.sum(F.when(counted, F.col("n"))).alias("raw_item_count"),
        F.sum(F.when(counted & parsed, F.col("n")).otherwise(0)).alias("_parsed"),
        F.count(F.when(~counted, True)).alias("_new"),
        F.map_from_entries(
            F.collect_list(F.when(skipped, F.struct("skip_reason", F.col("n").cast("int").alias("n"))))
        ).alias("skip_counts"),
    )
    # Where the run or the page is not known, no lot counts as new.
    fresh = F.when(F.col("run_id").isNull() | F.col("page").isNull(), F.lit(0).cast("long")).otherwise(F.col("_new"))
    tally = by_page.where(F.col("raw_item_count").isNotNull()).select(
        *page,
        "raw_item_count",
        fresh.alias("parsed_lot_count"),
        (F.col("_parsed") - fresh).alias("duplicate_count"),
        "skip_counts",
    )
    if pages is None:
        return tally
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("raw_item_count", "parsed_lot_count", "duplicate_count")}
    none = F.coalesce("skip_counts", F.create_map().cast("map<string,int>"))
    return pages.select(*page).join(tally, page, "left").withColumns({**zeros, "skip_counts": none})


def state_snapshot(discovered: DataFrame, counters: DataFrame, status: str, now, context: str | None = None) -> DataFrame:
    """(source, mode, state) with the figures of a run: counters, time span, and how many ids and urls it discovered.

    `discovered` has source, mode, source_auction_id, canonical_url and ended_at; `counters` one row per (source, mode).
    The ids and urls themselves are rows of `discoveries`.
    """
    keys = ["source", "mode"]
    kinds = {"auction_ids_discovered": "source_auction_id", "auction_urls_discovered": "canonical_url"}
    spans = discovered.groupBy(*keys).agg(
        F.min("ended_at").alias("oldest"), F.max("ended_at").alias("newest"), *[F.count(c).alias(k) for k, c in kinds.items()]
    )
    joined = counters.join(spans, keys, "left")
    number_columns = [c for c in counters.columns if c not in keys]
    stamp = text_fragment(now.cast("string"))
    ending = {"success": "last_success_at", "cancelled": "last_cancelled_at", "error": "last_error_at"}
    parts = [F.lit("last_status"), text_fragment(F.lit(status)), F.lit("last_progress_at"), stamp]
    for name in [*number_columns, *kinds]:
        parts += [F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("0"))]
    for name, column in (("oldest_ended_at", "oldest"), ("newest_ended_at", "newest")):
        parts += [F.lit(name), text_fragment(F.col(column).cast("string"))]
    if context:
        parts += [F.lit("last_context"), text_fragment(F.lit(context))]
    if status in ending:
        parts += [F.lit(ending[status]), stamp]
    return joined.select(*keys, F.create_map(*parts).alias("state"), now.alias("last_run_at"))


def discoveries(discovered: DataFrame) -> DataFrame:
    """Every id and url a run discovered as a row: source, mode, run_id, kind, value."""
    values = F.array(
        F.struct(F.lit("auction_id").alias("kind"), F.col("source_auction_id").alias("value")),
        F.struct(F.lit("auction_url").alias("kind"), F.col("canonical_url").alias("value")),
    )
    rows = discovered.select("source", "mode", "run_id", F.inline(values))
    return rows.where(F.col("value").isNotNull())


def merge_state(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Crawl state per (source, mode): the newer keys win, others stay."""
    keys = ["source", "mode"]
    both = existing.select(*keys, F.col("state").alias("_old"), F.col("last_run_at").alias("_then")).join(
        updates, keys, "full"
    )
    empty = F.create_map().cast("map<string,string>")
    return both.select(
        *keys,
        F.map_concat(F.coalesce("_old", empty), F.coalesce("state", empty)).alias("state"),
        F.coalesce("last_run_at", "_then").alias("last_run_at"),
    )


def worker_totals(runs: DataFrame) -> DataFrame:
    """Found and inserted over all workers of a source."""
    return runs.groupBy("source").agg(
        F.sum("records_found").alias("records_found"), F.sum("records_inserted").alias("records_inserted")
    )


def target_progress(targets: DataFrame, by: list[str]) -> DataFrame:
    """Targets started, completed, failed and remaining."""
    state = F.col("state")
    count = lambda test: F.count(F.when(test, True))
    return targets.groupBy(*by).agg(
        count(state != "pending").alias("targets_started"),
        count(state == "fetched").alias("targets_completed"),
        count(state.isin("blocked", "error")).alias("targets_failed"),
        count(state == "pending").alias("targets_remaining"),
        F.count(F.lit(1)).alias("target_total"),
    )
