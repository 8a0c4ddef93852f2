"""Registered queries of the ingestion side: extraction, upsert, targets, raw pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotledger.functions import urls
from lotledger.functions.identifiers import is_vin
from lotledger.functions.maps import text_fragment, to_object
from lotledger.functions.text import visible_text
from lotledger.operators import detail_pages, list_items, market, paging, quality, tallies, targets, upsert
from lotledger.operators.filters import equal_to, keep, raw_page_predicates
from lotledger.plans import replay
from lotledger.plans.oracle_views import LOTS, PAGES, canonical_sql
from lotledger.plans.registry import Registry
from lotledger.plans.runs import RunContext
from lotledger.schemas import LOT_FIELDS, RECORD_FIELDS, TARGET_FIELDS, camel_json, shaped
from lotledger.session import shared_folder
from lotledger.sources import derived, observed
from lotledger.sources.listing_pages import exploded_items, with_paging, with_payload
from lotledger.sources.raw_pages import new_artifacts, register_pages
from lotledger.streaming import ingest

REGISTRY = Registry()
register = REGISTRY.query

CUT = "1998-06-30"
OBSERVED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Observations with the derived defect, as in `sources.derived`.
ITEMS = LOTS.replace("FROM described)", ", l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, c_name, c_mktsegment,\n    o_orderpriority, n_name FROM described)", 1) + """, items AS (SELECT *,
  CASE WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'A' THEN 'no_title'
       WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'N' THEN 'parts_or_non_car'
       WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'R' THEN 'no_url'
       WHEN o_orderpriority = '2-HIGH' AND l_returnflag = 'A' THEN 'no_year'
       WHEN o_orderpriority = '2-HIGH' AND l_returnflag = 'N' THEN 'no_price'
       WHEN o_orderpriority = '2-HIGH' AND l_returnflag = 'R' THEN 'no_end_date'
       WHEN o_orderpriority = '3-MEDIUM' AND l_returnflag = 'A' THEN 'parse_error' END AS defect
  FROM keyed)
"""
COLORS_SQL = "white|black|silver|grey|gray|blue|red|yellow|green|orange|brown|purple|gold|tan|beige"


def _times(df, *names):
    """Timestamps without zone, as the tables have them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _parsed_first(spark, folder):
    items = derived.first_site_items(spark, folder).withColumn("item", F.try_parse_json("item_json"))
    return list_items.first_site_lots(items)


@register(
    "extract_listed_lots",
    ITEMS + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'bring_a_trailer' AS source, source_auction_id,
 canonical_url, auction_status, CASE WHEN auction_status = 'sold' THEN high_bid END AS sold_price, high_bid,
 bid_count, 'USD' AS currency,
 CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 1 HOUR ELSE l_shipdate END AS ended_at,
 year, make, model, "trim",
 mileage, CASE WHEN regexp_extract(lower("trim"), '\\b({COLORS_SQL})\\b') <> ''
   THEN upper(left(regexp_extract(lower("trim"), '\\b({COLORS_SQL})\\b'), 1))
     || substr(regexp_extract(lower("trim"), '\\b({COLORS_SQL})\\b'), 2) END AS exterior_color,
 n_name AS location,
 concat('{{"country":"', n_name, '","no_reserve":', CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END, '}}')
   AS vehicle_details,
 concat('https://img.example/p/', l_partkey, ' https://img.example/s/', l_suppkey) AS image_urls
 FROM items WHERE defect IS NULL""",
)
def _(spark, folder):
    found = list_items.accepted(_parsed_first(spark, folder).withColumn("l_suppkey", F.col("page")))
    plain = found.withColumns(
        {"vehicle_details": to_object(F.col("vehicle_details")), "image_urls": F.array_join("image_urls", " ")}
    )
    names = ["source", "source_auction_id", "canonical_url", "auction_status", "sold_price", "high_bid", "bid_count",
             "currency", "ended_at", "year", "make", "model", "trim", "mileage", "exterior_color", "location",
             "vehicle_details", "image_urls"]
    return _times(plain.select(*OBSERVED, *names), "ended_at")


@register(
    "extract_skip_reasons",
    ITEMS + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, defect AS skip_reason,
 CASE WHEN defect = 'no_url' THEN '' ELSE canonical_url END AS url, source_auction_id
 FROM items WHERE defect IS NOT NULL""",
)
def _(spark, folder):
    lost = list_items.rejected(_parsed_first(spark, folder).withColumn("l_suppkey", F.col("page")))
    return lost.select(*OBSERVED, "skip_reason", "url", "source_auction_id")


def _parsed_second(spark, folder):
    items = derived.second_site_items(spark, folder).withColumn("item", F.try_parse_json("item_json"))
    return list_items.second_site_lots(items, F.lit("2026-01-01").cast("timestamp"))


_SECOND_REASON = """CASE WHEN defect IN ('no_title', 'no_url', 'no_year', 'no_price') THEN defect END"""


@register(
    "extract_api_lots",
    ITEMS + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'cars_and_bids' AS source, source_auction_id,
 concat('https://carsandbids.com/auctions/', source_auction_id, '/') AS canonical_url, auction_status,
 CASE WHEN auction_status = 'sold' THEN high_bid END AS sold_price, high_bid, bid_count,
 l_shipdate - INTERVAL 2 HOUR AS ended_at, year, make, model, "trim", mileage, transmission, location,
 c_name AS seller, concat('~', "trim", ', ', n_name) AS subtitle,
 concat('https://media.example/', source_auction_id, '.jpg https://img.example/p/', l_partkey) AS image_urls,
 concat('{{', CASE WHEN l_linestatus = 'F' THEN '"drivetrain":"",' ELSE '' END, '"location":"', n_name,
   '","no_reserve":', CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END, ',"seller":',
   CASE WHEN l_returnflag = 'N' THEN concat('{{"username":"', c_name, '"}}') ELSE concat('"', c_name, '"') END,
   ',"transmission":"', l_returnflag, '"}}') AS vehicle_details
 FROM items WHERE {_SECOND_REASON} IS NULL""",
)
def _(spark, folder):
    found = list_items.accepted(_parsed_second(spark, folder))
    plain = found.withColumns(
        {"vehicle_details": to_object(F.col("vehicle_details")), "image_urls": F.array_join("image_urls", " ")}
    )
    names = ["source", "source_auction_id", "canonical_url", "auction_status", "sold_price", "high_bid", "bid_count",
             "ended_at", "year", "make", "model", "trim", "mileage", "transmission", "location", "seller",
             "subtitle", "image_urls", "vehicle_details"]
    return _times(plain.select(*OBSERVED, *names), "ended_at")


@register(
    "extract_api_skip_reasons",
    ITEMS + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SECOND_REASON} AS skip_reason
 FROM items WHERE {_SECOND_REASON} IS NOT NULL""",
)
def _(spark, folder):
    return list_items.rejected(_parsed_second(spark, folder)).select(*OBSERVED, "skip_reason")


_VIN = "rpad(upper(left(sha1(source_auction_id), 12)), 17, '0')"


@register(
    "extract_detail_pages",
    ITEMS + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 concat(c_name) AS seller, concat(n_name, ' & more') AS location, c_mktsegment AS seller_type,
 CAST(l_orderkey AS VARCHAR) AS lot_number, bid_count, title AS description,
 CASE WHEN year < 1981 THEN concat('AR', l_partkey) ELSE {_VIN} END AS chassis,
 CASE WHEN year < 1981 THEN TRUE ELSE regexp_matches({_VIN}, '^[A-HJ-NPR-Z0-9]{{17}}$') END AS chassis_is_vin,
 mileage, concat(exterior_color, ' “Metallic” Paint') AS exterior_color,
 CASE WHEN l_returnflag = 'A' THEN 'Five-Speed Manual Transmission' ELSE 'Automatic Transaxle' END AS transmission,
 concat(l_linenumber, '.0-Liter V8') AS engine,
 CASE WHEN mileage IS NULL THEN 6 ELSE 7 END AS bullet_count,
 concat('https://img.example/p/', l_partkey, ' https://b.example/wp-content/uploads/', source_auction_id, '.jpg')
   AS image_urls
 FROM items""",
)
def _(spark, folder):
    read = detail_pages.detail_payload(derived.detail_html(spark, folder))
    d, found = F.col("detail"), F.col("detail.extracted")
    return read.where(~F.col("detail_error")).select(
        *OBSERVED,
        d["seller"].alias("seller"),
        d["location"].alias("location"),
        d["seller_type"].alias("seller_type"),
        d["lot_number"].alias("lot_number"),
        d["bid_count"].alias("bid_count"),
        d["description"].alias("description"),
        found["chassis"].alias("chassis"),
        is_vin(found["chassis"], F.col("year")).alias("chassis_is_vin"),
        found["mileage"].alias("mileage"),
        found["exterior_color"].alias("exterior_color"),
        found["transmission"].alias("transmission"),
        found["engine"].alias("engine"),
        F.size(d["listing_details"]).alias("bullet_count"),
        F.array_join(d["image_urls"], " ").alias("image_urls"),
    )


@register(
    "result_page_items",
    ITEMS + """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', strftime(l_shipdate, '%Y%m%d')) AS id,
 0 AS pos, l_linenumber * 24 AS items_total, 24 AS items_per_page, 1 AS page_current,
 CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS pages_total,
 CASE WHEN l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0 THEN concat('{"keyword":"', l_suppkey, '"}') ELSE '{}' END AS base_filter,
 source_auction_id FROM items""",
)
def _(spark, folder):
    pages = with_paging(with_payload(derived.result_pages(spark, folder)))
    items = exploded_items(pages)
    return items.select(
        "id", "pos", "items_total", "items_per_page", "page_current", "pages_total", "base_filter",
        F.try_variant_get("item", "$.id", "string").alias("source_auction_id"),
    )


# --- upsert -----------------------------------------------------------------------------


def _records(spark, folder):
    """Observations as scraped records; a third of them without auction id."""
    seen = observed.observations(spark, folder, place=True)
    return seen.withColumns(
        {
            "source_auction_id": F.when(F.col("transmission") != "N", F.col("source_auction_id")),
            "bid_count": F.when(F.col("transmission") != "R", F.col("bid_count")),
            "seller": F.lit(None).cast("string"),
            "vehicle_details": F.create_map(
                F.concat(F.lit("flag_"), "transmission"), text_fragment(F.col("trim"))
            ),
            "detail_payload": F.when(F.col("detail_scraped_at").isNotNull(), '{"a":1}').otherwise("{}"),
            "ord": F.col("seen"),
        }
    )


def _early_and_late(spark, folder, *needed):
    """Stored lots (latest early observation of each) and the later records.

    With `needed` both hold these fields only, beside the id of the lots and the order of the records: what a
    maximum carries is not pruned, so all other fields would pass the shuffle unread.
    """
    fields = {c: k for c, k in RECORD_FIELDS.items() if not needed or c in needed}
    records = _records(spark, folder)
    early, late = (records.where(F.col("ended_at") <= CUT), records.where(F.col("ended_at") > CUT))
    rest = [c for c in early.columns if c != "id" and (not needed or c in needed)]
    stored = early.groupBy("id").agg(F.max_by(F.struct(*rest), "seen").alias("_r")).select("id", "_r.*")
    return shaped(stored, {"id": "string", **fields} if needed else LOT_FIELDS), late.select(
        "ord", *[(F.col(c) if c in late.columns else F.lit(None)).cast(k).alias(c) for c, k in fields.items()]
    )


_SPLIT = f"""
, records AS (SELECT id AS full_id, source, CASE WHEN transmission <> 'N' THEN source_auction_id END AS source_auction_id,
   canonical_url, auction_status, sold_price, high_bid, CASE WHEN transmission <> 'R' THEN bid_count END AS bid_count,
   ended_at, mileage, transmission, location, title, "trim", detail_scraped_at, created_at,
   concat('https://img.example/p/', l_partkey, ' https://img.example/s/', l_suppkey) AS images,
   concat(strftime(l_shipdate, '%Y%m%d'), lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR), 12, '0')) AS ord
   FROM keyed),
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY full_id ORDER BY ord DESC) AS nth
   FROM records WHERE ended_at <= TIMESTAMP '{CUT}') WHERE nth = 1),
late AS (SELECT * FROM records WHERE ended_at > TIMESTAMP '{CUT}'),
batch_ids AS (SELECT DISTINCT full_id FROM late WHERE source_auction_id IS NOT NULL),
late_keyed AS (SELECT *, CASE WHEN full_id IN (SELECT full_id FROM early) OR full_id IN (SELECT full_id FROM batch_ids)
   THEN full_id ELSE sha256(concat_ws(':', source, 'url', canonical_url)) END AS lot_id FROM late)
"""


@register(
    "resolve_lot_identities",
    LOTS + _SPLIT + """SELECT DISTINCT source, source_auction_id, canonical_url, lot_id FROM late_keyed""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder, *upsert.RAW_KEY)
    return upsert.resolve_identities(stored, late).where(F.col("conflict").isNull()).drop("conflict")


@register(
    "upsert_lots",
    LOTS + _SPLIT + """, history AS (
  SELECT lot_id, ord, 1 AS batch, * EXCLUDE (lot_id, ord, full_id) FROM late_keyed
  UNION ALL BY NAME
  SELECT full_id AS lot_id, ord, 0 AS batch, * EXCLUDE (full_id, ord, nth) FROM early
   WHERE full_id IN (SELECT lot_id FROM late_keyed)),
marked AS (SELECT *, max(ord) FILTER (detail_scraped_at IS NOT NULL) OVER (PARTITION BY lot_id) AS k FROM history),
entries AS (SELECT lot_id, concat('"flag_', transmission, '":"', arg_max("trim", ord), '"') AS entry
  FROM marked WHERE k IS NULL AND FALSE OR (k IS NOT NULL AND ord >= k) GROUP BY lot_id, transmission),
details AS (SELECT lot_id, concat('{', string_agg(entry, ',' ORDER BY entry), '}') AS d FROM entries GROUP BY lot_id),
folded AS (SELECT lot_id AS id, max(k) AS k, min(batch) = 1 AS inserted, sum(batch) AS record_count,
  arg_max(auction_status, ord) AS auction_status, arg_max(high_bid, ord) AS high_bid, arg_max(title, ord) AS title,
  arg_max(CASE WHEN sold_price IS NULL THEN -1 ELSE sold_price END, ord) AS sold_price,
  arg_max(CASE WHEN source_auction_id IS NULL THEN '' ELSE source_auction_id END, ord) AS source_auction_id,
  arg_max(CASE WHEN mileage IS NULL THEN -1 ELSE mileage END, ord) AS last_mileage,
  arg_max(mileage, ord) FILTER (mileage IS NOT NULL AND ord >= k) AS kept_mileage,
  arg_max(CASE WHEN bid_count IS NULL THEN -1 ELSE bid_count END, ord) AS last_bids,
  arg_max(bid_count, ord) FILTER (bid_count IS NOT NULL AND ord >= k) AS kept_bids,
  arg_max(transmission, ord) AS transmission, max(detail_scraped_at) FILTER (ord = k) AS detail_scraped_at,
  arg_max(images, ord) AS last_images, arg_max(images, ord) FILTER (ord = k) AS kept_images,
  arg_max(concat('{"flag_', transmission, '":"', "trim", '"}'), ord) AS last_details
  FROM marked GROUP BY lot_id)
SELECT id, inserted, CAST(record_count AS BIGINT) AS record_count, nullif(source_auction_id, '') AS source_auction_id,
 auction_status, high_bid, title, nullif(sold_price, -1) AS sold_price, transmission, detail_scraped_at,
 CASE WHEN k IS NULL THEN nullif(last_mileage, -1) ELSE kept_mileage END AS mileage,
 CASE WHEN k IS NULL THEN nullif(last_bids, -1) ELSE kept_bids END AS bid_count,
 CASE WHEN k IS NULL THEN last_images ELSE kept_images END AS image_urls,
 CASE WHEN k IS NULL THEN last_details ELSE d END AS vehicle_details,
 CASE WHEN k IS NULL THEN '{}' ELSE '{"a":1}' END AS detail_payload
FROM folded LEFT JOIN details ON id = lot_id""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder)
    result = upsert.upsert_lots(stored, late, F.lit("2026-01-01").cast("timestamp"))
    plain = result.lots.select(
        "id", "inserted", "record_count", "source_auction_id", "auction_status", "high_bid", "title", "sold_price",
        "transmission", "detail_scraped_at", "mileage", "bid_count",
        F.array_join("image_urls", " ").alias("image_urls"),
        to_object(F.col("vehicle_details")).alias("vehicle_details"), "detail_payload",
    )
    return _times(plain, "detail_scraped_at")


@register(
    "lot_table_after_upsert",
    LOTS + _SPLIT + """, merged AS (SELECT lot_id, ord, high_bid, auction_status FROM late_keyed
  UNION ALL SELECT full_id, ord, high_bid, auction_status FROM early)
SELECT lot_id AS id, arg_max(high_bid, ord) AS high_bid, arg_max(auction_status, ord) AS auction_status
FROM merged GROUP BY lot_id""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder)
    changed = upsert.upsert_lots(stored, late, F.lit("2026-01-01").cast("timestamp")).lots
    return upsert.apply_changes(stored, changed).select("id", "high_bid", "auction_status")


@register(
    "run_counters",
    LOTS + _SPLIT + """, first_runs AS (SELECT lot_id, arg_min(strftime(ended_at, '%Y-%m'), ord) AS run_id FROM late_keyed
   WHERE lot_id NOT IN (SELECT full_id FROM early) GROUP BY lot_id),
 found AS (SELECT strftime(ended_at, '%Y-%m') AS run_id, count(*) AS n FROM late_keyed GROUP BY 1),
 added AS (SELECT run_id, count(*) AS m FROM first_runs GROUP BY 1)
SELECT run_id, n AS records_found, coalesce(m, 0) AS records_inserted, n - coalesce(m, 0) AS records_updated
FROM found LEFT JOIN added USING (run_id)""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder, *upsert.RAW_KEY, "ended_at")
    records = late.withColumn("run_id", F.date_format("ended_at", "yyyy-MM"))
    known = upsert.resolve_identities(stored, late).where(F.col("conflict").isNull())
    return upsert.run_counters(records, known, stored)


def _on_shared_urls(spark, folder):
    """Late records under a url per part, which several auction ids share; the run is the month."""
    _, late = _early_and_late(spark, folder)
    shared = late.withColumn("canonical_url", F.col("image_urls")[0])
    return shared.withColumn("run_id", F.date_format("ended_at", "yyyy-MM"))


# The smallest auction id of a url owns it; records without id follow the url.
_SHARED = LOTS + _SPLIT + """, shared AS (SELECT source, source_auction_id, split_part(images, ' ', 1) AS canonical_url, ord, high_bid,
   strftime(ended_at, '%Y-%m') AS run_id FROM late),
owned AS (SELECT *, min(source_auction_id) OVER (PARTITION BY source, canonical_url) AS owner FROM shared),
judged AS (SELECT *, coalesce(source_auction_id <> owner, FALSE) AS apart, sha256(CASE WHEN coalesce(source_auction_id, owner) IS NULL
   THEN concat(source, ':url:', canonical_url) ELSE concat(source, ':id:', coalesce(source_auction_id, owner)) END) AS lot_id FROM owned)
"""


@register(
    "conflicting_records",
    _SHARED + """SELECT source, source_auction_id, canonical_url, high_bid, lot_id, 'url_shared_by_ids' AS conflict
FROM judged WHERE apart""",
)
def _(spark, folder):
    records = _on_shared_urls(spark, folder)
    none = _early_and_late(spark, folder)[0].where(F.lit(False))
    found = upsert.upsert_lots(none, records, F.lit("2026-01-01").cast("timestamp")).conflicts
    return found.select("source", "source_auction_id", "canonical_url", "high_bid", "lot_id", "conflict")


@register(
    "lots_beside_conflicts",
    _SHARED + """SELECT lot_id AS id, count(*) AS record_count, arg_max(high_bid, ord) AS high_bid FROM judged WHERE NOT apart GROUP BY 1""",
)
def _(spark, folder):
    records = _on_shared_urls(spark, folder)
    none = _early_and_late(spark, folder)[0].where(F.lit(False))
    return upsert.upsert_lots(none, records, F.lit("2026-01-01").cast("timestamp")).lots.select("id", "record_count", "high_bid")


@register(
    "run_counters_with_conflicts",
    _SHARED + """, firsts AS (SELECT lot_id, arg_min(run_id, ord) AS run_id FROM judged WHERE NOT apart GROUP BY lot_id),
 added AS (SELECT run_id, count(*) AS m FROM firsts GROUP BY 1),
 found AS (SELECT run_id, count(*) AS n, count(*) FILTER (NOT apart) AS placed FROM judged GROUP BY 1)
SELECT run_id, n AS records_found, coalesce(m, 0) AS records_inserted, placed - coalesce(m, 0) AS records_updated
FROM found LEFT JOIN added USING (run_id)""",
)
def _(spark, folder):
    records = _on_shared_urls(spark, folder)
    none = _early_and_late(spark, folder)[0].where(F.lit(False))
    known = upsert.resolve_identities(none, records)
    return upsert.run_counters(records, known.where(F.col("conflict").isNull()), none)


@register(
    "records_not_persisted",
    LOTS + _SPLIT + """SELECT source, source_auction_id, canonical_url, ended_at FROM late
 WHERE CASE WHEN source_auction_id IS NULL THEN concat(source, ':url:', canonical_url)
            ELSE concat(source, ':id:', source_auction_id) END NOT IN
  (SELECT CASE WHEN source_auction_id IS NULL THEN concat(source, ':url:', canonical_url)
               ELSE concat(source, ':id:', source_auction_id) END FROM early)""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder, *upsert.RAW_KEY, "ended_at")
    left = upsert.without_known(late, stored)
    return _times(left.select("source", "source_auction_id", "canonical_url", "ended_at"), "ended_at")


@register(
    "lots_without_detail_of_run",
    LOTS + _SPLIT + """SELECT DISTINCT full_id AS id, source FROM early e WHERE detail_scraped_at IS NULL AND (
  (source, source_auction_id) IN (SELECT source, source_auction_id FROM late WHERE source_auction_id IS NOT NULL)
  OR (source, canonical_url) IN (SELECT source, canonical_url FROM late))""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder, *upsert.RAW_KEY, "detail_scraped_at")
    return upsert.undetailed_lots(stored, late)


@register(
    "lots_due_for_refresh",
    LOTS + _SPLIT + f"""SELECT source, source_auction_id, canonical_url, ended_at FROM late l WHERE NOT EXISTS (
   SELECT 1 FROM early e WHERE e.detail_scraped_at >= TIMESTAMP '{CUT}' - INTERVAL 365 DAY AND e.source = l.source
   AND e.canonical_url = l.canonical_url)""",
)
def _(spark, folder):
    stored, late = _early_and_late(spark, folder, *upsert.RAW_KEY, "ended_at", "detail_scraped_at")
    due = upsert.lots_to_refresh(late, stored, F.lit(CUT).cast("timestamp"), days=365)
    return _times(due.select("source", "source_auction_id", "canonical_url", "ended_at"), "ended_at")


@register(
    "first_seen_per_run",
    LOTS + """SELECT run_id, canonical_url, high_bid FROM (SELECT strftime(ended_at, '%Y') AS run_id, canonical_url, high_bid,
 row_number() OVER (PARTITION BY strftime(ended_at, '%Y'), canonical_url ORDER BY l_shipdate, l_partkey, l_suppkey) AS nth
 FROM keyed) WHERE nth = 1""",
)
def _(spark, folder):
    seen = observed.observations(spark, folder, vehicle=False)
    rows = seen.select(F.date_format("ended_at", "yyyy").alias("run_id"), "canonical_url", "high_bid", "seen")
    return tallies.first_seen(rows, order="seen").select("run_id", "canonical_url", "high_bid")


_TALLY = """, firsts AS (SELECT *, row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m'), canonical_url, defect IS NULL
   ORDER BY l_shipdate, l_partkey, l_suppkey) AS nth FROM items),
tally AS (SELECT strftime(l_shipdate, '%Y-%m') AS run_id, l_suppkey AS page, count(*) AS raw_item_count,
  count(*) FILTER (defect IS NULL AND nth = 1) AS parsed_lot_count,
  count(*) FILTER (defect IS NULL AND nth > 1) AS duplicate_count,
  CAST(count(*) FILTER (defect = 'no_title') AS INTEGER) AS no_title,
  CAST(count(*) FILTER (defect = 'no_price') AS INTEGER) AS no_price,
  CAST(count(*) FILTER (defect = 'parse_error') AS INTEGER) AS parse_error
  FROM firsts GROUP BY 1, 2)
"""


def _tally(spark, folder):
    parsed = _parsed_first(spark, folder)
    return tallies.page_tally(parsed.withColumn("canonical_url", F.col("lot.canonical_url")))


@register("page_tally", ITEMS + _TALLY + "SELECT * FROM tally")
def _(spark, folder):
    skips = lambda name: F.coalesce(F.try_element_at("skip_counts", F.lit(name)), F.lit(0)).alias(name)
    return _tally(spark, folder).select(
        "run_id", "page", "raw_item_count", "parsed_lot_count", "duplicate_count",
        skips("no_title"), skips("no_price"), skips("parse_error"),
    )


@register(
    "quality_nothing_parsed",
    ITEMS + _TALLY + """SELECT run_id, 'bring_a_trailer' AS source, 'warning' AS severity, 'zero_parsed_lots' AS code,
  concat('BaT page ', page, ' returned raw items but parsed zero lots.') AS message,
  CAST(raw_item_count AS VARCHAR) AS raw_items
  FROM tally WHERE parsed_lot_count = 0 AND duplicate_count = 0""",
)
def _(spark, folder):
    rows = quality.nothing_parsed(_tally(spark, folder))
    return rows.select("run_id", "source", "severity", "code", "message", F.col("metadata")["raw_item_count"].alias("raw_items"))


@register(
    "quality_nothing_parsed_second_site",
    ITEMS + _TALLY + """SELECT run_id, 'cars_and_bids' AS source, 'zero_parsed_lots' AS code
  FROM tally WHERE parsed_lot_count = 0""",
)
def _(spark, folder):
    return quality.nothing_parsed(_tally(spark, folder), "cars_and_bids").select("run_id", "source", "code")


@register(
    "quality_pagination",
    ITEMS + """, paged AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS pages_total,
   l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0 AS has_filter FROM items)
SELECT 'bat_pagination_incomplete' AS code, 'warning' AS severity, concat('BaT page ', l_suppkey, ' exposes ', pages_total,
  ' completed-result pages; incremental mode will parse 5 pages.') AS message, CAST(pages_total AS VARCHAR) AS pages
 FROM paged WHERE pages_total > 5
UNION ALL SELECT 'bat_pagination_missing_filter', 'critical', concat('BaT page ', l_suppkey,
  ' has more pages but no base_filter metadata.'), CAST(pages_total AS VARCHAR) FROM paged
 WHERE pages_total > 1 AND NOT has_filter""",
)
def _(spark, folder):
    pages = with_paging(with_payload(derived.result_pages(spark, folder))).withColumns(
        {
            "label": F.col("l_suppkey").cast("string"),
            "parsed_first_page": F.col("item_count"),
            "page_limit": targets.page_limit(F.col("pages_total"), "incremental", 5),
        }
    )
    both = quality.all_anomalies(quality.pagination_incomplete(pages), quality.pagination_without_filter(pages))
    return both.select("code", "severity", "message", F.col("metadata")["pages_total"].alias("pages"))


@register(
    "quality_unreadable_items",
    ITEMS + """SELECT 'parse_error' AS code, 'warning' AS severity, canonical_url AS url,
  concat('"', source_auction_id, '"') AS source_auction_id FROM items WHERE defect = 'parse_error'""",
)
def _(spark, folder):
    rows = quality.unreadable_items(list_items.rejected(_parsed_first(spark, folder)))
    return rows.select("code", "severity", "url", F.col("metadata")["source_auction_id"].alias("source_auction_id"))


@register(
    "crawl_state_snapshot",
    LOTS + """SELECT source, CAST(count(*) AS VARCHAR) AS records_found, concat('"', strftime(min(ended_at), '%Y-%m-%d %H:%M:%S'), '"') AS oldest_ended_at,
 concat('"', strftime(max(ended_at), '%Y-%m-%d %H:%M:%S'), '"') AS newest_ended_at,
 CAST(count(source_auction_id) AS VARCHAR) AS ids, CAST(count(canonical_url) AS VARCHAR) AS urls
FROM lots GROUP BY source""",
)
def _(spark, folder):
    found = _discovered(spark, folder)
    counters = found.groupBy("source", "mode").agg(F.count(F.lit(1)).alias("records_found"))
    state = tallies.state_snapshot(found, counters, "success", F.lit("2026-01-01").cast("timestamp"))
    part = lambda name: F.col("state")[name]
    return state.select(
        "source",
        part("records_found").alias("records_found"),
        part("oldest_ended_at").alias("oldest_ended_at"),
        part("newest_ended_at").alias("newest_ended_at"),
        part("auction_ids_discovered").alias("ids"),
        part("auction_urls_discovered").alias("urls"),
    )


@register(
    "crawl_discoveries",
    LOTS + """SELECT source, 'incremental' AS mode, 'run-1' AS run_id, kind, value FROM (
 SELECT source, 'auction_id' AS kind, source_auction_id AS value FROM lots
 UNION ALL SELECT source, 'auction_url', canonical_url FROM lots) WHERE value IS NOT NULL""",
)
def _(spark, folder):
    found = _discovered(spark, folder).withColumn("run_id", F.lit("run-1"))
    return tallies.discoveries(found)


def _discovered(spark, folder):
    rows = observed.latest_lineitems(spark, folder, "l_extendedprice", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    described = observed.describe(rows, spark, folder, vehicle=False, place=False)
    columns = observed.lot_columns(False, False)
    return described.select(
        *[columns[c].alias(c) for c in ("id", "source", "source_auction_id", "canonical_url", "ended_at")]
    ).withColumn("mode", F.lit("incremental"))


# --- raw pages and targets --------------------------------------------------------------


@register("canonical_urls", f"SELECT page_id, {canonical_sql('url')} AS canonical_url FROM pages")
def _(spark, folder):
    return observed.table(spark, folder, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@register("request_fingerprints", PAGES + "SELECT ord, canonical_url, fingerprint FROM discovered")
def _(spark, folder):
    found = targets.with_fingerprint(observed.discovered_targets(spark, folder))
    return found.select("ord", "canonical_url", F.col("request_fingerprint").alias("fingerprint"))


@register(
    "register_raw_pages",
    PAGES + """SELECT id, source, target_type, url, canonical_url, status_code, sha256(content) AS content_sha256,
 concat('local://', source, '/', strftime(fetched_at, '%Y/%m/%d'), '/', sha256(content), '.html.gz') AS artifact_uri,
 CAST(octet_length(encode(content)) AS INTEGER) AS size_bytes, fetched_at,
 CASE target_type WHEN 'bat_model_page' THEN '20' ELSE '80' END AS target_priority FROM fetched""",
)
def _(spark, folder):
    pages = register_pages(observed.fetched_pages(spark, folder))
    return _times(pages, "fetched_at").select(
        "id", "source", "target_type", "url", "canonical_url", "status_code", "content_sha256", "artifact_uri",
        "size_bytes", "fetched_at", F.col("metadata")["target_priority"].alias("target_priority"),
    )


@register(
    "new_artifacts",
    PAGES + """SELECT DISTINCT source, CAST(fetched_at AS DATE) AS fetch_date, sha256(content) AS content_sha256 FROM fetched
 WHERE fetched_at >= TIMESTAMP '2024-01-15'
 AND (source, CAST(fetched_at AS DATE), sha256(content)) NOT IN
  (SELECT source, CAST(fetched_at AS DATE), sha256(content) FROM fetched WHERE target_type = 'bat_model_page')""",
)
def _(spark, folder):
    pages = register_pages(observed.fetched_pages(spark, folder))
    stored = pages.where(F.col("target_type") == "bat_model_page").withColumn("fetch_date", F.to_date("fetched_at"))
    fresh = pages.where(F.col("fetched_at") >= F.lit("2024-01-15").cast("timestamp"))
    return new_artifacts(stored, fresh).select("source", "fetch_date", "content_sha256")


@register(
    "raw_pages_newest",
    PAGES + """SELECT id, source, target_type, url, status_code, fetched_at FROM fetched WHERE source = 'bring_a_trailer'
 AND target_type = 'bat_detail_page' AND status_code = 200 AND url ILIKE '%EXAMPLE.com%'
 ORDER BY fetched_at DESC NULLS FIRST, id LIMIT 50""",
)
def _(spark, folder):
    wanted = raw_page_predicates(source="bring_a_trailer", target_type="bat_detail_page", status_code=200, url="EXAMPLE.com")
    pages = keep(observed.fetched_pages(spark, folder), wanted)
    return paging.newest(pages, 50, "fetched_at", "created_at").select(
        "id", "source", "target_type", "url", "status_code", "fetched_at"
    )


@register("raw_page_by_id", PAGES + "SELECT id, url, canonical_url FROM fetched WHERE id = '17'")
def _(spark, folder):
    pages = market.by_id(observed.fetched_pages(spark, folder), "17")
    return pages.select("id", "url", urls.canonical_url(F.col("url")).alias("canonical_url"))


def _queue(spark, folder):
    """Known targets (from model pages) and what all pages bring anew."""
    found = observed.discovered_targets(spark, folder)
    start = F.lit("2024-02-01").cast("timestamp")
    nothing = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in TARGET_FIELDS.items()))
    known = targets.enqueue(nothing, found.where(F.col("target_type") == "bat_model_page"), start)
    return shaped(known, TARGET_FIELDS), found


@register(
    "enqueue_targets",
    PAGES + """, first AS (SELECT fingerprint, arg_min(url, ord) AS url, arg_min(id, ord) AS discovered_from, min(priority) AS priority,
   arg_max(id, ord) AS last_note, max(CASE WHEN turn = 0 THEN id END) AS turn_0, bool_or(target_type = 'bat_model_page') AS known,
   min(canonical_url) AS canonical_url
  FROM discovered GROUP BY fingerprint)
SELECT fingerprint AS request_fingerprint, url, canonical_url, discovered_from, priority, concat('', last_note) AS last_note,
 NOT known AS is_new, 'pending' AS state FROM first""",
)
def _(spark, folder):
    known, found = _queue(spark, folder)
    queued = targets.enqueue(known, found, F.lit("2024-03-01").cast("timestamp"))
    return queued.select(
        "request_fingerprint", "url", "canonical_url", "discovered_from", "priority",
        F.col("metadata")["last"].alias("last_note"), "is_new", "state",
    )


_TARGETS = """, queue AS (SELECT fingerprint AS id, arg_min(source, ord) AS source, arg_min(target_type, ord) AS target_type,
  min(priority) AS priority, arg_min(id, ord) AS discovered_from FROM discovered GROUP BY fingerprint)
, page_events AS (SELECT q.id, f.page_id, CASE WHEN f.status_code = 429 THEN 'blocked' ELSE 'fetched' END AS event
  FROM queue q JOIN fetched f ON f.id = q.discovered_from WHERE q.target_type = 'bat_model_page')
, states AS (SELECT q.*, coalesce(e.event, 'pending') AS state,
   CASE WHEN e.event = 'blocked' THEN 'refused' END AS last_error FROM queue q LEFT JOIN page_events e USING (id))
"""


def _target_states(spark, folder):
    found = observed.discovered_targets(spark, folder)
    nothing = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in TARGET_FIELDS.items()))
    queue = shaped(targets.enqueue(nothing, found, F.lit("2024-02-01").cast("timestamp")), TARGET_FIELDS)
    pages = observed.fetched_pages(spark, folder)
    refused = F.col("status_code") == 429
    # Every target of a model page is tried twice: a failure that may be repeated, then the answer.
    tries = queue.where(F.col("target_type") == "bat_model_page").select(
        F.col("id").alias("target_id"), F.col("discovered_from").alias("_page")
    ).join(pages.select(F.col("id").alias("_page"), "status_code"), "_page")
    answer = tries.select(
        "target_id", F.lit(2).alias("ord"),
        F.when(refused, "blocked").otherwise("fetched").alias("event"),
        F.when(refused, "refused").alias("error"),
        F.when(~refused, F.col("_page")).alias("raw_page_id"),
    )
    return targets.current_state(queue, answer)


@register(
    "target_states",
    PAGES + _TARGETS + "SELECT id, source, target_type, priority, state, last_error FROM states",
)
def _(spark, folder):
    return _target_states(spark, folder).select("id", "source", "target_type", "priority", "state", "last_error")


@register(
    "target_progress",
    PAGES + _TARGETS + """SELECT source, count(*) FILTER (state <> 'pending') AS targets_started,
 count(*) FILTER (state = 'fetched') AS targets_completed, count(*) FILTER (state IN ('blocked', 'error')) AS targets_failed,
 count(*) FILTER (state = 'pending') AS targets_remaining, count(*) AS target_total FROM states GROUP BY source""",
)
def _(spark, folder):
    return tallies.target_progress(_target_states(spark, folder), ["source"])


@register(
    "ready_targets",
    PAGES + _TARGETS + """SELECT id, priority, state FROM states WHERE source = 'bring_a_trailer' AND state = 'pending'
 ORDER BY priority, id LIMIT 20""",
)
def _(spark, folder):
    rows = paging.ready_targets(
        _target_states(spark, folder), "bring_a_trailer", F.lit("2024-06-01").cast("timestamp"), 20
    )
    return rows.select("id", "priority", "state")


@register(
    "targets_by_urgency",
    PAGES + _TARGETS + """SELECT id, priority, state FROM states WHERE source = 'cars_and_bids' AND target_type = 'bat_detail_page'
 AND state = 'pending' ORDER BY priority, id LIMIT 30""",
)
def _(spark, folder):
    wanted = equal_to(source="cars_and_bids", target_type="bat_detail_page", state="pending")
    return paging.targets_by_urgency(keep(_target_states(spark, folder), wanted), 30).select("id", "priority", "state")


def _two_batches(spark, folder):
    """A store in which all targets are queued and all tries have landed in two batches, the second one twice."""
    store = ingest.Store(f"{shared_folder(spark)}/targets-{uuid.uuid4().hex}")
    ingest.queue_targets(observed.customer_targets(spark, folder), store, "000000000", F.lit("2024-01-01").cast("timestamp"))
    tries, half = observed.target_tries(spark, folder), F.lit("2024-01-15").cast("timestamp_ntz")
    ingest.land_pages(tries.where(F.col("fetched_at") < half), store, "000000001")
    for _ in range(2):
        ingest.land_pages(tries.where(F.col("fetched_at") >= half), store, "000000002")
    return ingest.current_targets(spark, store)


_TRIES = """
WITH tries AS (SELECT user_id, CAST(event_id AS VARCHAR) AS page_id, ts, (event_id % 3 + 1) * 60 AS wait,
  CASE event_type WHEN 'view' THEN 'fetched' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'failed_retryable' END AS event,
  CASE event_type WHEN 'error' THEN '404' WHEN 'click' THEN '503' WHEN 'signup' THEN '429' END AS status,
  CASE WHEN user_id % 2 = 0 THEN 'BaT' ELSE 'cars_and_bids' END AS site FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, page_id DESC) AS nth,
  row_number() OVER (PARTITION BY user_id, event = 'fetched' ORDER BY ts DESC, page_id DESC) AS nth_alike FROM tries),
folded AS (SELECT user_id, CAST(count(*) AS INTEGER) AS attempts, max(event) FILTER (nth = 1) AS event,
  max(ts + to_seconds(wait)) FILTER (nth = 1 AND event = 'failed_retryable') AS next_fetch_at,
  max(CASE WHEN status IS NULL THEN 'timed out' ELSE concat(site, ' returned ', status) END) FILTER (nth_alike = 1 AND event <> 'fetched') AS last_error,
  max(page_id) FILTER (nth_alike = 1 AND event = 'fetched') AS raw_page_id FROM numbered GROUP BY user_id),
stored AS (SELECT concat('https://auctions.example/listing/', c_custkey) AS canonical_url,
  CASE WHEN c_custkey % 2 = 0 THEN 'bring_a_trailer' ELSE 'cars_and_bids' END AS source,
  CASE event WHEN 'fetched' THEN 'fetched' WHEN 'failed' THEN 'error' WHEN 'blocked' THEN 'blocked' ELSE 'pending' END AS state,
  coalesce(attempts, 0) AS attempts, next_fetch_at, last_error, raw_page_id
  FROM customer LEFT JOIN folded ON user_id = c_custkey)
"""


@register(
    "target_transitions",
    _TRIES + "SELECT canonical_url, state, attempts, next_fetch_at, last_error, concat('\"', raw_page_id, '\"') AS raw_page_id FROM stored",
)
def _(spark, folder):
    quoted = F.coalesce(F.try_element_at("metadata", F.lit("raw_page_id")), F.lit('""'))
    rows = _two_batches(spark, folder).select(
        "canonical_url", "state", "attempts", "next_fetch_at", "last_error", quoted.alias("raw_page_id")
    )
    return _times(rows, "next_fetch_at")


@register(
    "ready_targets_of_store",
    _TRIES + """SELECT canonical_url, attempts FROM stored WHERE source = 'bring_a_trailer' AND state = 'pending'
 AND coalesce(next_fetch_at <= TIMESTAMP '2024-01-30 12:00:00', TRUE)
 ORDER BY sha256(concat_ws(chr(31), source, 'bat_detail_page', 'GET', canonical_url, '{}')) LIMIT 40""",
)
def _(spark, folder):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return paging.ready_targets(_two_batches(spark, folder), "bring_a_trailer", now, 40).select("canonical_url", "attempts")


_DETAIL_PRINT = "sha256(concat_ws(chr(31), 'bring_a_trailer', 'bat_detail_page', 'GET', rtrim(canonical_url, '/'), '{}'))"


@register(
    "enqueue_missing_details",
    LOTS + f"""SELECT {_DETAIL_PRINT} AS request_fingerprint, canonical_url AS url, 80 AS priority,
  concat('"', source_auction_id, '"') AS source_auction_id, TRUE AS is_new
  FROM (SELECT * FROM lots WHERE source = 'bring_a_trailer' AND detail_scraped_at IS NULL)""",
)
def _(spark, folder):
    missing = paging.lots_without_detail(observed.lots(spark, folder), "bring_a_trailer")
    found = targets.detail_targets(missing.withColumn("ord", F.col("ended_at")))
    nothing = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in TARGET_FIELDS.items()))
    queued = targets.enqueue(nothing, found, F.lit("2024-02-01").cast("timestamp"))
    return queued.select(
        "request_fingerprint", "url", "priority", F.col("metadata")["source_auction_id"].alias("source_auction_id"), "is_new"
    )


@register(
    "detail_targets_of_lots",
    LOTS + f"""SELECT {_DETAIL_PRINT} AS request_fingerprint, min(canonical_url) AS url, 80 AS priority FROM keyed GROUP BY 1""",
)
def _(spark, folder):
    seen = observed.observations(spark, folder).withColumn("ord", F.col("seen"))
    folded = targets.fold_targets(targets.detail_targets(seen))
    return folded.select("request_fingerprint", "url", "priority")


@register(
    "remaining_result_pages",
    ITEMS + """, paged AS (SELECT *, concat('https://bringatrailer.com/make-', l_suppkey, '/') AS referer FROM items
   WHERE l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0),
expanded AS (SELECT *, unnest(range(2, l_linenumber + 1)) AS n FROM paged)
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', strftime(l_shipdate, '%Y%m%d')) AS discovered_from,
 30 AS priority, concat('{"base_filter":{"keyword":"', l_suppkey, '"},"page":', n, ',"per_page":24,"referer_url":"', referer, '"}') AS payload
FROM expanded""",
)
def _(spark, folder):
    pages = with_paging(with_payload(derived.result_pages(spark, folder)))
    found = targets.result_page_targets(
        pages.withColumns({"raw_page_id": F.col("id"), "ord": F.col("fetched_at")})
    )
    return found.select("discovered_from", "priority", F.col("metadata")["request_payload"].alias("payload"))


@register(
    "page_visible_text",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""",
)
def _(spark, folder):
    return observed.table(spark, folder, "pages").select("page_id", visible_text(F.col("html")).alias("text"))


@register(
    "page_list_entries",
    """SELECT page_id, CAST(unnest(generate_series(0, len(found) - 1)) AS INTEGER) AS pos, unnest(found) AS entry FROM (
 SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS found FROM pages) WHERE len(found) > 0""",
)
def _(spark, folder):
    found = F.regexp_extract_all("html", F.lit(detail_pages.BULLET), F.lit(1))
    return observed.table(spark, folder, "pages").select("page_id", F.posexplode(found).alias("pos", "entry"))


# --- replay of stored pages -------------------------------------------------------------


def _replayed(spark, folder, both_sites=False, pages_again=False):
    """All parts of the result read the parsed items and the identities, so both are stored once; `pages_again`
    stores what is known of the pages in the same table, for results that join pages and items: no page is read twice."""
    fetched = derived.result_pages(spark, folder)
    if both_sites:
        fetched = fetched.unionByName(derived.captured_answers(spark, folder), allowMissingColumns=True)
    pages = register_pages(fetched)
    no_lots = spark.createDataFrame([], ", ".join(f"`{k}` {v}" for k, v in LOT_FIELDS.items()))
    no_links = spark.createDataFrame([], "raw_page_id string, lot_id string, relationship_type string")
    no_targets = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in TARGET_FIELDS.items()))
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"

    def stored(df, name):
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    loaded = replay.load_list_pages(pages)
    parsed = stored(replay.parse_items(loaded, with_pages=pages_again), "items")
    if pages_again:
        loaded, parsed = replay.pages_and_items(parsed)
    now = F.lit("2026-01-01").cast("timestamp")
    return replay.parse_list_pages(
        loaded, parsed, no_lots, no_links, no_targets, now, keep=lambda df: stored(df, "identities")
    )


_PAGE_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', strftime(l_shipdate, '%Y%m%d'))"


@register(
    "replay_lots",
    ITEMS + """, sound AS (SELECT *, concat(strftime(l_shipdate, '%Y%m%d'), ' ', concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)) AS o
   FROM items WHERE defect IS NULL)
SELECT sha256(concat('bring_a_trailer:id:', source_auction_id)) AS id, count(*) AS record_count,
 arg_max(high_bid, o) AS high_bid, arg_max(title, o) AS vehicle FROM sound GROUP BY source_auction_id""",
)
def _(spark, folder):
    lots = _replayed(spark, folder).lots
    vehicle = F.regexp_replace("title", r"^\d+k-Mile ", "")
    return lots.select("id", "record_count", "high_bid", vehicle.alias("vehicle"))


@register(
    "replay_links",
    ITEMS + f"""SELECT {_PAGE_ID} AS raw_page_id, sha256(concat('bring_a_trailer:id:', source_auction_id)) AS lot_id,
 'list' AS relationship_type FROM items WHERE defect IS NULL""",
)
def _(spark, folder):
    return _replayed(spark, folder).links


@register(
    "replay_parse_runs",
    ITEMS + f""", ordered AS (SELECT *, {_PAGE_ID} AS raw_page_id,
    row_number() OVER (PARTITION BY source_auction_id, defect IS NULL ORDER BY l_shipdate, {_PAGE_ID}) AS nth,
    row_number() OVER (PARTITION BY canonical_url, defect IS NULL ORDER BY l_shipdate, {_PAGE_ID}) AS url_nth FROM items)
SELECT raw_page_id, 'bat_completed_results' AS parser_name, 'bat-list-raw-v1' AS parser_version, 'success' AS status,
 CAST(CASE WHEN defect IS NULL THEN 1 ELSE 0 END AS BIGINT) AS records_found,
 CAST(CASE WHEN defect IS NULL AND nth = 1 THEN 1 ELSE 0 END AS BIGINT) AS records_inserted,
 CAST(CASE WHEN defect IS NULL AND nth > 1 THEN 1 ELSE 0 END AS BIGINT) AS records_updated FROM ordered""",
)
def _(spark, folder):
    return _replayed(spark, folder, pages_again=True).parse_runs.drop("targets_discovered", "finished_at")


# Items without a lot at the second site, and the empty answers among its pages.
_SECOND_LOST = "defect IN ('no_title', 'no_url', 'no_year', 'no_price')"


@register(
    "replay_lots_of_both_sites",
    ITEMS + f""", seen AS (
 SELECT 'bring_a_trailer' AS source, *, {_PAGE_ID} AS page FROM items WHERE defect IS NULL
 UNION ALL SELECT 'cars_and_bids' AS source, *, concat('c-', {_PAGE_ID}) AS page FROM items
 WHERE defect IS NULL OR NOT ({_SECOND_LOST} OR defect = 'parse_error')),
placed AS (SELECT source AS site, source_auction_id, high_bid, concat(strftime(l_shipdate, '%Y%m%d'), ' ', page) AS o FROM (SELECT source, page, * EXCLUDE (source, page) FROM seen))
SELECT sha256(concat(site, ':id:', source_auction_id)) AS id, site AS source, count(*) AS record_count, arg_max(high_bid, o) AS high_bid
FROM placed GROUP BY site, source_auction_id""",
)
def _(spark, folder):
    return _replayed(spark, folder, both_sites=True).lots.select("id", "source", "record_count", "high_bid")


@register(
    "replay_parse_runs_of_both_sites",
    ITEMS + f"""SELECT {_PAGE_ID} AS raw_page_id, 'bat_completed_results' AS parser_name, 'success' AS status,
 CAST(CASE WHEN defect IS NULL THEN 1 ELSE 0 END AS BIGINT) AS records_found FROM items
UNION ALL SELECT concat('c-', {_PAGE_ID}), 'captured_auctions', 'success',
 CAST(CASE WHEN coalesce({_SECOND_LOST} OR defect = 'parse_error', FALSE) THEN 0 ELSE 1 END AS BIGINT) FROM items""",
)
def _(spark, folder):
    return _replayed(spark, folder, both_sites=True, pages_again=True).parse_runs.select("raw_page_id", "parser_name", "status", "records_found")


@register(
    "replay_anomalies_of_both_sites",
    ITEMS + f"""SELECT {_PAGE_ID} AS run_id, 'bring_a_trailer' AS source, 'warning' AS severity, 'zero_parsed_lots' AS code,
 concat('https://bringatrailer.com/make-', l_suppkey, '/') AS url,
 concat('BaT page https://bringatrailer.com/make-', l_suppkey, '/ returned raw items but parsed zero lots.') AS message FROM items WHERE defect IS NOT NULL
UNION ALL SELECT NULL, 'bring_a_trailer', 'warning', 'parse_error', NULL, 'BaT completed-result item failed to parse.' FROM items WHERE defect = 'parse_error'
UNION ALL SELECT concat('c-', {_PAGE_ID}), 'cars_and_bids', 'warning', 'zero_parsed_lots', concat('https://carsandbids.com/past-auctions/?q=', l_suppkey),
 'Cars & Bids returned raw auctions but parsed zero lots.' FROM items WHERE {_SECOND_LOST}
UNION ALL SELECT concat('c-', {_PAGE_ID}), 'cars_and_bids', 'critical', 'no_closed_auction_response', concat('https://carsandbids.com/past-auctions/?q=', l_suppkey),
 'Cars & Bids returned no closed-auction API results.' FROM items WHERE defect = 'parse_error'""",
)
def _(spark, folder):
    found = _replayed(spark, folder, both_sites=True, pages_again=True).anomalies
    # The item's own url tells more than the contract of this query needs.
    own = F.when(F.col("code") != "parse_error", F.col("url"))
    return found.select("run_id", "source", "severity", "code", own.alias("url"), "message")


def _ingested(spark, folder):
    """A store after two runs over all pages: sound lists (every fiftieth part refused), answers of the second site and some
    detail pages; then the lists without any lot and the model directories."""
    store = ingest.Store(f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    refused = F.when(F.col("l_partkey") % 50 == 0, 429).otherwise(200)
    lists = derived.result_pages(spark, folder)
    details = derived.detail_html(spark, folder).where(F.col("l_linenumber") == 2).select(
        F.concat_ws("-", F.lit("t"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.lit("bring_a_trailer").alias("source"), F.lit("bat_detail_page").alias("target_type"),
        F.col("canonical_url").alias("url"), F.lit("text/html").alias("content_type"), F.col("html").alias("content"),
        F.lit("1999-06-01").cast("timestamp_ntz").alias("fetched_at"),
    )
    first = lists.where(F.col("defect").isNull()).withColumn("status_code", refused)
    for other in (derived.captured_answers(spark, folder), details):
        first = first.unionByName(other, allowMissingColumns=True)
    second = lists.where(F.col("defect").isNotNull()).unionByName(derived.directory_pages(spark, folder), allowMissingColumns=True)
    for number, pages in enumerate((first, second), 1):
        run = RunContext(f"run-{number}", page_limit=3)
        ingest.ingest_pages(register_pages(pages), store, f"{number:09d}", buckets=8, run=run)
    return store


_RUNS = ITEMS + f""", lists AS (SELECT *, {_PAGE_ID} AS page_id, concat('https://bringatrailer.com/make-', l_suppkey, '/') AS url,
  CASE WHEN defect IS NULL THEN 'run-1' ELSE 'run-2' END AS run_id, CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS pages_total,
  l_linenumber % 3 <> 0 AS is_html, defect IS NULL AND l_partkey % 50 = 0 AS refused FROM items),
answers AS (SELECT *, 'run-1' AS run_id, concat('https://carsandbids.com/past-auctions/?q=', l_suppkey) AS url,
  coalesce(defect = 'parse_error', FALSE) AS is_empty, coalesce({_SECOND_LOST}, FALSE) AS lost,
  row_number() OVER (PARTITION BY source_auction_id, coalesce({_SECOND_LOST} OR defect = 'parse_error', FALSE) ORDER BY l_shipdate, concat('c-', {_PAGE_ID})) AS nth FROM items),
sound AS (SELECT * FROM lists WHERE defect IS NULL AND NOT refused)
"""


@register(
    "ingest_anomalies",
    _RUNS + """SELECT NULL AS run_id, 'bring_a_trailer' AS source, 'critical' AS severity, 'blocked_response' AS code, url,
 'request refused by bring_a_trailer' AS message FROM lists WHERE refused
UNION ALL SELECT run_id, 'bring_a_trailer', 'warning', 'bat_pagination_incomplete', url,
 concat('BaT page ', url, ' exposes ', pages_total, ' completed-result pages; incremental mode will parse 3 pages.') FROM lists WHERE NOT refused AND is_html AND pages_total > 3
UNION ALL SELECT run_id, 'bring_a_trailer', 'critical', 'bat_pagination_missing_filter', url,
 concat('BaT page ', url, ' has more pages but no base_filter metadata.') FROM lists WHERE NOT refused AND is_html AND pages_total > 1 AND l_linenumber % 2 = 1
UNION ALL SELECT run_id, 'bring_a_trailer', 'warning', 'zero_parsed_lots', url,
 concat('BaT page ', url, ' returned raw items but parsed zero lots.') FROM lists WHERE defect IS NOT NULL
UNION ALL SELECT NULL, 'bring_a_trailer', 'warning', 'parse_error', canonical_url, 'BaT completed-result item failed to parse.' FROM lists WHERE defect = 'parse_error'
UNION ALL SELECT run_id, 'cars_and_bids', 'critical', 'no_closed_auction_response', url, 'Cars & Bids returned no closed-auction API results.' FROM answers WHERE is_empty
UNION ALL SELECT run_id, 'cars_and_bids', 'warning', 'zero_parsed_lots', url, 'Cars & Bids returned raw auctions but parsed zero lots.'
 FROM answers WHERE NOT is_empty AND (lost OR nth > 1)
UNION ALL SELECT 'run-2', 'bring_a_trailer', 'warning', 'zero_lots', NULL, 'bring_a_trailer returned zero auction lots.'
 WHERE EXISTS (SELECT 1 FROM lists WHERE defect IS NOT NULL)
UNION ALL SELECT 'run-1', 'bring_a_trailer', 'warning', 'missing_detail_enrichment', NULL, concat('bring_a_trailer has ', count(DISTINCT source_auction_id),
 ' persisted lots from this run without detail enrichment.') FROM sound WHERE l_linenumber <> 2 HAVING count(*) > 0
UNION ALL SELECT 'run-2', 'bring_a_trailer', 'critical', 'models_directory_empty', concat('https://bringatrailer.com/models/?s=', s_suppkey),
 'BaT models directory returned no crawl targets.' FROM supplier WHERE s_suppkey % 2 = 1""",
)
def _(spark, folder):
    found = ingest.stored_anomalies(spark, _ingested(spark, folder))
    return found.select("run_id", "source", "severity", "code", "url", "message")


@register(
    "ingest_runs_and_state",
    _RUNS + """, runs AS (
 SELECT 'run-1' AS id, 'bring_a_trailer' AS source, count(*) AS found, count(DISTINCT source_auction_id) AS inserted FROM sound
 UNION ALL SELECT 'run-1', 'cars_and_bids', count(*), count(DISTINCT source_auction_id) FROM answers WHERE NOT is_empty AND NOT lost
 UNION ALL SELECT 'run-2', 'bring_a_trailer', 0, 0)
SELECT id, source, 'incremental' AS mode, 'success' AS status, CAST(found AS INTEGER) AS records_found,
 CAST(inserted AS INTEGER) AS records_inserted, CAST(found - inserted AS INTEGER) AS records_updated,
 CASE WHEN source = 'bring_a_trailer' THEN '0' ELSE CAST(found AS VARCHAR) END AS last_found,
 CASE WHEN source = 'bring_a_trailer' THEN '0' ELSE CAST(inserted AS VARCHAR) END AS last_ids FROM runs""",
)
def _(spark, folder):
    store = _ingested(spark, folder)
    state = ingest.crawl_state(spark, store).select(
        "source", "mode", F.col("state")["records_found"].alias("last_found"), F.col("state")["auction_ids_discovered"].alias("last_ids")
    )
    runs = ingest.stored_runs(spark, store).join(state, ["source", "mode"], "left")
    return runs.select(
        "id", "source", "mode", "status", "records_found", "records_inserted", "records_updated", "last_found", "last_ids"
    )


@register(
    "targets_seeded_by_directories",
    """SELECT concat('https://bringatrailer.com/make-', s_suppkey, '/') AS url, 'pending' AS state, 20 AS priority, '"Model & Co"' AS label
FROM supplier WHERE s_suppkey % 2 = 0""",
)
def _(spark, folder):
    store = ingest.Store(f"{shared_folder(spark)}/seeds-{uuid.uuid4().hex}")
    landed = ingest.land_pages(register_pages(derived.directory_pages(spark, folder)), store, "000000001")
    for _ in range(2):
        ingest.seed_from_directories(landed, store, "000000001", F.lit("2024-01-01").cast("timestamp"))
    return ingest.current_targets(spark, store).select("url", "state", "priority", F.col("metadata")["label"].alias("label"))


@register(
    "lot_json_records",
    LOTS + """SELECT concat('{"id":"', id, '","sourceAuctionId":"', source_auction_id, '","auctionStatus":"', auction_status,
 '","soldPrice":', coalesce(CAST(sold_price AS VARCHAR), 'null'), ',"highBid":', high_bid, '}') AS json FROM lots""",
)
def _(spark, folder):
    rows = observed.lots(spark, folder, vehicle=False)
    return camel_json(rows.select("id", "source_auction_id", "auction_status", "sold_price", "high_bid"))

