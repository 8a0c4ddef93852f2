"""Keyed upsert of scraped records into the lot table.

Applying records one by one in their order is restated as aggregations, so a batch of any
size merges in one job. For one lot let k be its last record with a detail page:

* without k the last record is the state;
* else every detail field is the last filled value from k on (k's own value if there is
  none), `vehicle_details` is the union from k on, the images are those of k, and all other
  fields come from the last record.

Each part is a maximum over the record order and therefore combines on the map side: a lot
that makes up a third of the batch costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.functions.images import ordered_distinct
from lotledger.functions.keys import batch_key, lot_id
from lotledger.functions.maps import entries_to_map, last_entries
from lotledger.schemas import DETAIL_FIELDS, LOT_FIELDS, RECORD_FIELDS

PRESERVED = [c for c in DETAIL_FIELDS if c != "vehicle_details"]
LAST = [c for c in RECORD_FIELDS if c not in PRESERVED]
RAW_KEY = ["source", "source_auction_id", "canonical_url"]


@dataclass(frozen=True)
class Upsert:
    """`lots`: new state of all touched lots, with `inserted` and `record_count`.
    `identities`: lot id of every (source, auction id, url) of the batch.
    `conflicts`: the whole records, with their order, whose identity points at another lot as well
    (`lot_id` is that of their auction id); they are not merged.
    """

    lots: DataFrame
    identities: DataFrame
    conflicts: DataFrame


def _raw_key() -> Column:
    return F.concat_ws(
        "\u001f", "source", F.coalesce("source_auction_id", F.lit("")), "canonical_url"
    )


def resolve_identities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Lot id and `conflict` per distinct (source, auction id, url) of the batch.

    The auction id decides, then the url. Instead of one OR join (a nested loop) there are
    two equi joins against the three identity columns of the table.

    A url belongs to one auction id: that of the stored lot if the batch names it, else the smallest
    of the batch. Other ids on it are in conflict (`url_shared_by_ids`), and so is an id whose
    lot is not the one stored under the url (`id_and_url_disagree`). That concerns the one combination
    only: other urls of the id, and records without id on the url, keep their lots.
    """
    raw = incoming.select(
        "source", F.nullif(F.col("source_auction_id"), F.lit("")).alias("source_auction_id"), "canonical_url"
    ).distinct()
    known = existing.select(
        "source", F.nullif(F.col("source_auction_id"), F.lit("")).alias("_known_id"), "canonical_url", "id"
    )
    id_side = known.where(F.col("_known_id").isNotNull()).select(
        "source", F.col("_known_id").alias("_id"), F.col("id").alias("_match_id")
    )
    url_side = known.select("source", "canonical_url", F.col("_known_id").alias("_holder"), F.col("id").alias("_match_url"))
    own_id, url_lot = F.col("source_auction_id"), F.col("_match_url")
    by_url = raw.join(url_side, ["source", "canonical_url"], "left")
    other = (~own_id.eqNullSafe(F.col("_holder"))).alias("other")
    owners = by_url.where(own_id.isNotNull()).groupBy("source", "canonical_url").agg(
        F.min(F.struct(other, own_id.alias("owner")))["owner"].alias("_owner")
    )
    matched = (
        by_url.join(owners, ["source", "canonical_url"], "left")
        .withColumn("_id", F.coalesce(own_id, "_owner"))
        .withColumn("_shared", F.coalesce(own_id != F.col("_owner"), F.lit(False)))
        .join(id_side, ["source", "_id"], "left")
        .withColumn("_member", batch_key(F.col("source"), F.col("_id"), F.col("canonical_url")))
    )
    # All urls of one auction id belong to the same lot, also when only one of them is known.
    members = matched.groupBy("_member").agg(
        F.coalesce(F.min("_match_id"), F.min(F.when(~F.col("_shared"), url_lot)), lot_id(F.col("_member"))).alias("_lot")
    )
    return matched.join(members, "_member").select(
        *RAW_KEY,
        F.when(own_id.isNull(), F.coalesce(url_lot, "_lot")).otherwise(F.col("_lot")).alias("lot_id"),
        F.when(F.col("_shared"), "url_shared_by_ids")
        .when(own_id.isNotNull() & (url_lot != F.col("_lot")), "id_and_url_disagree")
        .alias("conflict"),
    )


def _is_filled(name: str) -> Column:
    value = F.col(name)
    return value.isNotNull() & (value != "{}") if name == "detail_payload" else value.isNotNull()


def _blank() -> Column:
    """Whether a payload is there but holds nothing: the one value that is neither missing nor filled."""
    return (F.col("detail_payload") == "{}").alias("blank")


def _states(records: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable state per key: last record, what the last detailed record alone decides, last filled fields.

    Each value is carried once. A preserved field of the last record, or of the last detailed one, is its last
    filled value if that has the same place in the order, and else missing (or a blank payload); so neither record
    repeats these fields, and page text stands in one column only.
    """
    detail_at = F.when(F.col("detail_scraped_at").isNotNull(), F.col("at"))
    return records.groupBy(*keys).agg(
        F.max("at").alias("last_at"),
        F.max_by(F.struct(*LAST, _blank()), "at").alias("last"),
        F.max(detail_at).alias("detail_at"),
        F.max_by(F.struct("vehicle_details", "image_urls", _blank()), detail_at).alias("detail"),
        F.count(F.lit(1)).alias("record_count"),
        *[
            F.max(F.when(_is_filled(f), F.struct("at", F.col(f).alias("value")))).alias(f"filled_{f}")
            for f in PRESERVED
        ],
    )


def _merge_states(states: DataFrame) -> DataFrame:
    return states.groupBy("lot_id").agg(
        F.max_by("last", "last_at").alias("last"),
        F.max("last_at").alias("last_at"),
        F.max_by("detail", "detail_at").alias("detail"),
        F.max("detail_at").alias("detail_at"),
        F.sum("record_count").alias("record_count"),
        F.max("stored_at").alias("stored_at"),
        *[F.max(f"filled_{f}").alias(f"filled_{f}") for f in PRESERVED],
    )


def _final_field(name: str) -> Column:
    """The closed form for one field over a merged state."""
    has_detail = F.col("detail_at").isNotNull()
    if name in PRESERVED:
        # Nothing is filled behind the last record, so "from it on" means "in it".
        filled, since = F.col(f"filled_{name}"), F.coalesce("detail_at", "last_at")
        blank = F.when(has_detail, F.col("detail.blank")).otherwise(F.col("last.blank"))
        nothing = F.when(blank, "{}") if name == "detail_payload" else F.lit(None)
        return F.when(filled["at"] >= since, filled["value"]).otherwise(nothing)
    last = F.col(f"last.{name}")
    if name == "vehicle_details":
        detail = F.col("detail.vehicle_details")
        since = F.filter(F.col("entries"), lambda e: e["at"] >= F.col("detail_at"))
        merged = F.when(F.size(since) > 0, entries_to_map(since)).otherwise(detail)
        return F.when(has_detail, merged).otherwise(last)
    if name == "image_urls":
        return ordered_distinct(F.when(has_detail, F.col("detail.image_urls")).otherwise(last))
    return last


def _as_is(df: DataFrame) -> DataFrame:
    return df


def upsert_lots(
    existing: DataFrame, incoming: DataFrame, now: Column, order: str = "ord", keep: Callable[[DataFrame], DataFrame] = _as_is
) -> Upsert:
    """Merge records (RECORD_FIELDS and a column that orders them, differently within a lot) into the lot table.

    The identities are read by all parts of the result; a job that writes them gives `keep`, which stores them once and
    reads them back.
    """
    identities = keep(resolve_identities(existing, incoming))
    good = identities.where(F.col("conflict").isNull()).select(_raw_key().alias("raw"), "lot_id")
    bad = identities.where(F.col("conflict").isNotNull()).select(_raw_key().alias("raw"), "lot_id", "conflict")
    records = incoming.select(
        _raw_key().alias("raw"), *RECORD_FIELDS, F.struct(F.lit(1).alias("batch"), F.col(order).alias("ord")).alias("at")
    )
    touched = good.select(F.col("lot_id").alias("id")).distinct()
    nothing = F.lit(None).cast(incoming.schema[order].dataType)
    stored = existing.join(touched, "id", "left_semi").select(
        F.col("id").alias("lot_id"),
        *RECORD_FIELDS,
        F.struct(F.lit(0).alias("batch"), nothing.alias("ord")).alias("at"),
        "created_at",
    )
    # First per raw identity, then per lot: the identity join sees no hot key any more.
    fresh = _states(records, ["raw"]).join(good, "raw").drop("raw").withColumn(
        "stored_at", F.lit(None).cast("timestamp")
    )
    kept = _states(stored, ["lot_id", "created_at"]).withColumn("record_count", F.lit(0).cast("long"))
    merged = _merge_states(fresh.unionByName(kept.withColumnRenamed("created_at", "stored_at")))

    fresh_entries = last_entries(records, ["raw"], "vehicle_details", "at").join(good, "raw")
    all_entries = fresh_entries.select("lot_id", F.inline("vehicle_details")).unionByName(
        stored.select("lot_id", "at", F.explode("vehicle_details").alias("key", "value")).select(
            "lot_id", "key", "value", "at"
        )
    )
    entries = (
        all_entries.groupBy("lot_id", "key")
        .agg(F.max(F.struct("at", "value")).alias("_last"))
        .groupBy("lot_id")
        .agg(F.collect_list(F.struct("key", "_last.value", "_last.at")).alias("entries"))
    )
    lots = merged.join(entries, "lot_id", "left").select(
        F.col("lot_id").alias("id"),
        *[_final_field(name).cast(kind).alias(name) for name, kind in RECORD_FIELDS.items()],
        F.coalesce("stored_at", now).cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("updated_at"),
        F.col("stored_at").isNull().alias("inserted"),
        "record_count",
    )
    return Upsert(
        lots=lots,
        identities=identities.where(F.col("conflict").isNull()).drop("conflict"),
        conflicts=incoming.select(_raw_key().alias("raw"), *RECORD_FIELDS, order).join(bad, "raw").drop("raw"),
    )


def apply_changes(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """The whole table after an upsert: untouched lots and the new state of the others."""
    untouched = existing.join(changed.select("id"), "id", "left_anti")
    return untouched.select(*LOT_FIELDS).unionByName(changed.select(*LOT_FIELDS))


def without_known(incoming: DataFrame, persisted: DataFrame) -> DataFrame:
    """Records whose batch key has not been persisted by this run."""
    key = batch_key(F.col("source"), F.col("source_auction_id"), F.col("canonical_url"))
    known = persisted.select(key.alias("_key")).distinct()
    return incoming.withColumn("_key", key).join(known, "_key", "left_anti").drop("_key")


def run_counters(records: DataFrame, identities: DataFrame, existing: DataFrame, order: str = "ord") -> DataFrame:
    """Found, inserted and updated records per run.

    A lot counts as inserted for the run that brings its first record, when the table does
    not hold it yet; every other record is an update. Records without an identity here (those in
    conflict) are found, but neither inserted nor updated.
    """
    raw = records.select("run_id", _raw_key().alias("raw"), F.col(order).alias("ord"))
    per_run = raw.groupBy("run_id", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    placed = per_run.join(identities.select(_raw_key().alias("raw"), "lot_id"), "raw", "left")
    firsts = (
        placed.where(F.col("lot_id").isNotNull())
        .groupBy("lot_id")
        .agg(F.min_by("run_id", "ord").alias("run_id"))
        .join(existing.select(F.col("id").alias("lot_id")), "lot_id", "left_anti")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("inserted"))
    )
    found = placed.groupBy("run_id").agg(
        F.sum("n").alias("records_found"), F.sum(F.when(F.col("lot_id").isNull(), F.col("n")).otherwise(0)).alias("_open")
    )
    inserted = F.coalesce("inserted", F.lit(0).cast("long"))
    return found.join(firsts, "run_id", "left").select(
        "run_id",
        "records_found",
        inserted.alias("records_inserted"),
        (F.col("records_found") - F.col("_open") - inserted).alias("records_updated"),
    )


def lots_to_refresh(batch: DataFrame, existing: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Lots of the batch whose detail page is missing or older than `days`."""
    cutoff = now - F.make_dt_interval(days=F.lit(days))
    current = existing.where(F.col("detail_scraped_at") >= cutoff)
    by_id = current.where(F.col("source_auction_id").isNotNull()).select("source", "source_auction_id")
    by_url = current.select("source", "canonical_url")
    return batch.join(by_id, ["source", "source_auction_id"], "left_anti").join(
        by_url, ["source", "canonical_url"], "left_anti"
    )


def undetailed_lots(existing: DataFrame, discovered: DataFrame) -> DataFrame:
    """Stored lots without detail page that a run discovered, by auction id or by url."""
    open_lots = existing.where(F.col("detail_scraped_at").isNull()).select(
        "id", "source", "source_auction_id", "canonical_url"
    )
    ids = discovered.where(F.col("source_auction_id").isNotNull()).select("source", "source_auction_id")
    urls = discovered.select("source", "canonical_url")
    return (
        open_lots.join(ids, ["source", "source_auction_id"], "left_semi")
        .select("id", "source")
        .union(open_lots.join(urls, ["source", "canonical_url"], "left_semi").select("id", "source"))
        .dropDuplicates(["id"])
    )
