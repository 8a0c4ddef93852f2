"""The same views as in `sources.observed`, as SQL text for the cross-check engine."""

from __future__ import annotations

LOTS = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem),
described AS (
  SELECT * FROM ranked
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
observations AS (
  SELECT rn, l_shipdate, l_partkey, l_suppkey,
    CASE WHEN l_orderkey % 2 = 0 THEN 'bring_a_trailer' ELSE 'cars_and_bids' END AS source,
    concat(l_orderkey, '-', l_linenumber) AS source_auction_id,
    concat('https://auctions.example/listing/', l_orderkey, '-', l_linenumber, '/') AS canonical_url,
    CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'reserve_not_met' ELSE 'withdrawn' END
      AS auction_status,
    CASE WHEN o_orderstatus = 'F' THEN CAST(floor(l_extendedprice) AS INTEGER) END AS sold_price,
    CAST(floor(l_extendedprice) AS INTEGER) AS high_bid,
    CAST(l_quantity AS INTEGER) AS bid_count,
    'USD' AS currency, o_orderdate AS listed_at, l_shipdate AS ended_at,
    CASE WHEN l_tax < 0.07 THEN CAST(l_quantity * 1000 AS INTEGER) END AS mileage,
    l_returnflag AS transmission, CAST(NULL AS VARCHAR) AS subtitle,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS detail_scraped_at,
    o_orderdate AS created_at,
    1975 + p_size AS year, p_brand AS make, p_type AS model, p_name AS "trim",
    split_part(p_name, ' ', 1) AS exterior_color,
    concat_ws(' ', 1975 + p_size, p_brand, p_type, p_name) AS title,
    n_name AS location
  FROM described),
keyed AS (
  SELECT *, sha256(concat_ws(':', source, 'id', source_auction_id)) AS id FROM observations),
lots AS (SELECT * FROM keyed WHERE rn = 1)
"""

LOGS = """
WITH request_logs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS run_id,
    CASE WHEN user_id % 2 = 0 THEN 'bring_a_trailer' ELSE 'cars_and_bids' END AS source,
    concat('https://auctions.example/listing/', event_id) AS url,
    CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
    CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 200 WHEN 'click' THEN 503
         WHEN 'signup' THEN 429 END AS status_code,
    CAST(floor(value) AS INTEGER) AS duration_ms,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'success' WHEN 'click' THEN 'retry'
         WHEN 'purchase' THEN 'skipped' ELSE 'blocked' END AS outcome,
    props, ts AS created_at
  FROM events),
anomalies AS (
  SELECT id, run_id, source,
    CASE outcome WHEN 'blocked' THEN 'critical' ELSE 'warning' END AS severity,
    CASE outcome WHEN 'blocked' THEN 'blocked_response' ELSE 'request_error' END AS code,
    concat('request ', id) AS message, url, created_at
  FROM request_logs WHERE outcome IN ('blocked', 'error')),
runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_custkey % 2 = 0 THEN 'bring_a_trailer' ELSE 'cars_and_bids' END AS source,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
    o_orderdate AS started_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at,
    CAST(floor(o_totalprice) AS INTEGER) AS records_found,
    CAST(floor(o_totalprice / 10) AS INTEGER) AS records_inserted,
    CAST(floor(o_totalprice / 20) AS INTEGER) AS records_updated,
    CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error
  FROM orders)
"""

# The canonical form of the URLs that occur in `pages`: plain hosts, unescaped queries.
_CANONICAL = """
concat(
  lower(regexp_extract({u}, '^([^:]+://[^/?#]*)', 1)),
  CASE WHEN regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/'
       ELSE rtrim(regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') END,
  CASE WHEN regexp_extract({u}, '\\?([^#]+)', 1) = '' THEN ''
       ELSE '?' || array_to_string(list_sort(string_split(regexp_extract({u}, '\\?([^#]+)', 1), '&')), '&')
  END)"""


def canonical_sql(column: str) -> str:
    return _CANONICAL.format(u=column)


PAGES = f"""
WITH fetched AS (
  SELECT CAST(page_id AS VARCHAR) AS id, page_id,
    CASE WHEN page_id % 2 = 0 THEN 'bring_a_trailer' ELSE 'cars_and_bids' END AS source,
    CASE WHEN page_id % 3 = 0 THEN 'bat_model_page' ELSE 'bat_detail_page' END AS target_type,
    url, {canonical_sql('url')} AS canonical_url,
    CASE WHEN page_id % 10 = 0 THEN 429 ELSE 200 END AS status_code,
    'text/html' AS content_type, html AS content,
    make_timestamp(2024, 1, CAST(page_id % 28 + 1 AS BIGINT), 0, 0, 0) AS fetched_at
  FROM pages),
shapes AS (
  SELECT id, page_id, source, target_type, url, 80 AS priority, 0 AS turn FROM fetched
  UNION ALL
  SELECT id, page_id, source, target_type, regexp_replace(url, '[?#].*$', '') || '/', 20, 1 FROM fetched),
discovered AS (
  SELECT *, page_id * 2 + turn AS ord, {canonical_sql('url')} AS canonical_url,
    sha256(concat_ws(chr(31), source, target_type, 'GET', {canonical_sql('url')}, '{{}}')) AS fingerprint
  FROM shapes)
"""
