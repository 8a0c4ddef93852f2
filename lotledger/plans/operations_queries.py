"""Registered queries of the operations console."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotledger.functions import urls
from lotledger.operators import operations, paging, quality, tallies
from lotledger.operators.filters import equal_to, keep, request_log_predicates, run_predicates
from lotledger.plans.oracle_views import LOGS, LOTS
from lotledger.plans.registry import Registry
from lotledger.schemas import REQUEST_LOG_FIELDS
from lotledger.session import shared_folder
from lotledger.sources import observed
from lotledger.sources.tables import BatchLog
from lotledger.streaming import feed

REGISTRY = Registry()
register = REGISTRY.query

LOG_COLUMNS = ["id", "run_id", "source", "url", "attempt", "status_code", "duration_ms", "outcome", "created_at"]
LOG_SQL = ", ".join(LOG_COLUMNS)
RUN_COLUMNS = ["id", "source", "status", "started_at", "finished_at", "records_found", "error"]
RUN_SQL = ", ".join(RUN_COLUMNS)


@register(
    "request_logs_errors",
    LOGS + f"""SELECT {LOG_SQL} FROM request_logs WHERE outcome IN ('error', 'retry', 'blocked', 'selector_missing')
 ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""",
)
def _(spark, folder):
    rows = keep(observed.request_logs(spark, folder), request_log_predicates(errors_only=True))
    return paging.newest(rows, 100, "created_at").select(*LOG_COLUMNS)


@register(
    "request_logs_filtered",
    LOGS + f"""SELECT {LOG_SQL} FROM request_logs WHERE source = 'bring_a_trailer' AND run_id = '8' AND outcome = 'blocked'
 AND status_code = 429""",
)
def _(spark, folder):
    wanted = request_log_predicates(source="bring_a_trailer", run_id="8", outcome="blocked", status_code=429)
    return keep(observed.request_logs(spark, folder), wanted).select(*LOG_COLUMNS)


@register("request_logs_any_status", LOGS + "SELECT count(*) AS n FROM request_logs WHERE source = 'cars_and_bids'")
def _(spark, folder):
    wanted = request_log_predicates(source="cars_and_bids", status_code=0, outcome="")
    return keep(observed.request_logs(spark, folder), wanted).agg(F.count(F.lit(1)).alias("n"))


@register(
    "anomalies_newest",
    LOGS + """SELECT id, run_id, source, severity, code, message, url, created_at FROM anomalies
 WHERE source = 'bring_a_trailer' AND severity = 'critical' ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""",
)
def _(spark, folder):
    stored = observed.anomalies(observed.request_logs(spark, folder))
    rows = keep(stored, equal_to(source="bring_a_trailer", severity="critical", run_id=None))
    return paging.newest(rows, 100, "created_at")


@register(
    "runs_with_errors",
    LOGS + f"""SELECT {RUN_SQL} FROM runs WHERE source = 'cars_and_bids' AND error IS NOT NULL
 ORDER BY started_at DESC NULLS FIRST, id LIMIT 50""",
)
def _(spark, folder):
    wanted = run_predicates(source="cars_and_bids", errors_only=True)
    return paging.newest(keep(observed.runs(spark, folder), wanted), 50, "started_at").select(*RUN_COLUMNS)


def _latest_sql(table: str, columns: str, when: str, condition: str = "TRUE") -> str:
    return (
        LOGS
        + f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {when} DESC, id DESC) AS nth
 FROM {table} WHERE {condition}) WHERE nth = 1"""
    )


@register(
    "latest_run_per_source",
    _latest_sql("runs", "source, id, status, started_at, finished_at, records_found, records_inserted, records_updated", "started_at"),
)
def _(spark, folder):
    return operations.latest_runs(observed.runs(spark, folder))


@register(
    "latest_success_per_source",
    _latest_sql("runs", "source, id, finished_at AS last_success_at", "started_at", "status = 'success'"),
)
def _(spark, folder):
    return operations.latest_successes(observed.runs(spark, folder))


@register(
    "latest_anomaly_per_source",
    _latest_sql("anomalies", "source, id, severity, code, message, created_at", "created_at"),
)
def _(spark, folder):
    return operations.latest_anomalies(observed.anomalies(observed.request_logs(spark, folder)))


def _health_sql(condition: str, now: str) -> str:
    return (
        LOGS
        + f""", sources AS (SELECT unnest(['bring_a_trailer', 'cars_and_bids']) AS source),
chosen AS (SELECT * FROM runs WHERE {condition}),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS nth FROM chosen) WHERE nth = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS nth FROM chosen
   WHERE status = 'success') WHERE nth = 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS nth FROM anomalies) WHERE nth = 1)
SELECT sources.source, CASE WHEN r.status = 'running' THEN 'running' WHEN r.status = 'error' THEN 'error'
  WHEN s.finished_at IS NULL OR s.finished_at < TIMESTAMP '{now}' - INTERVAL 36 HOUR THEN 'stale' ELSE 'idle' END AS state,
 r.started_at AS last_run_at, s.finished_at AS last_success_at, r.status AS latest_status,
 coalesce(r.records_found, 0) AS records_found, coalesce(r.records_inserted, 0) AS records_inserted,
 coalesce(r.records_updated, 0) AS records_updated, a.severity AS latest_anomaly_severity,
 a.message AS latest_anomaly_message,
 s.finished_at IS NULL OR s.finished_at < TIMESTAMP '{now}' - INTERVAL 36 HOUR AS is_stale
FROM sources LEFT JOIN r USING (source) LEFT JOIN s USING (source) LEFT JOIN a USING (source)"""
    )


@register("source_health", _health_sql("TRUE", "1999-01-01"))
def _(spark, folder):
    logs = observed.request_logs(spark, folder)
    now = F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))
    return operations.source_health(observed.runs(spark, folder), observed.anomalies(logs), now)


@register(
    "source_health_of_finished_runs",
    _health_sql("status = 'success' AND source = 'bring_a_trailer'", "1996-01-01"),
)
def _(spark, folder):
    logs = observed.request_logs(spark, folder)
    done = observed.runs(spark, folder).where("status = 'success' AND source = 'bring_a_trailer'")
    now = F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
    return operations.source_health(done, observed.anomalies(logs), now)


@register(
    "counts_per_run",
    LOGS + """, l AS (SELECT run_id, count(*) AS request_count, count(*) FILTER (outcome IN ('error', 'blocked')) AS failed_count
   FROM request_logs GROUP BY run_id),
 a AS (SELECT run_id, count(*) AS anomaly_count FROM anomalies GROUP BY run_id)
SELECT runs.id, runs.source, coalesce(request_count, 0) AS request_count, coalesce(failed_count, 0) AS failed_count,
 coalesce(anomaly_count, 0) AS anomaly_count FROM runs LEFT JOIN l ON l.run_id = id LEFT JOIN a ON a.run_id = id""",
)
def _(spark, folder):
    logs = observed.request_logs(spark, folder)
    counted = operations.counts_per_run(observed.runs(spark, folder), logs, observed.anomalies(logs))
    return counted.select("id", "source", "request_count", "failed_count", "anomaly_count")


@register(
    "runs_with_request_logs",
    LOGS + """SELECT runs.id, runs.status, l.id AS log_id, l.outcome FROM runs LEFT JOIN request_logs l ON l.run_id = runs.id""",
)
def _(spark, folder):
    logs = observed.request_logs(spark, folder).select(F.col("id").alias("log_id"), "run_id", "outcome")
    runs = observed.runs(spark, folder).select("id", "status")
    return operations.children(runs, logs, "run_id", ["log_id", "outcome"])


@register(
    "request_logs_within_retention",
    LOGS + f"""SELECT {LOG_SQL} FROM request_logs WHERE created_at >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY""",
)
def _(spark, folder):
    now = F.to_timestamp_ntz(F.lit("2024-04-10 00:00:00"))
    return operations.within_retention(observed.request_logs(spark, folder), now).select(*LOG_COLUMNS)


def _log(spark):
    return BatchLog(spark, f"{shared_folder(spark)}/request-logs-{uuid.uuid4().hex}", REQUEST_LOG_FIELDS)


def _appended(spark, folder):
    """All request logs appended in two batches; the first one had been lost halfway and was appended again."""
    logs, log = observed.request_logs(spark, folder), _log(spark)
    first = F.col("source") == "bring_a_trailer"
    log.append(logs.where(first & (F.col("attempt") < 3)), "000000001")
    log.append(logs.where(first), "000000001")
    log.append(logs.where(~first), "000000002")
    return log


def _log_rows(log):
    return log.read().withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register(
    "request_logs_appended_again",
    LOGS + f"""SELECT {LOG_SQL}, CASE WHEN source = 'bring_a_trailer' THEN '000000001' ELSE '000000002' END AS batch,
 CAST(created_at AS DATE) AS day FROM request_logs""",
)
def _(spark, folder):
    return _log_rows(_appended(spark, folder)).select(*LOG_COLUMNS, "batch", "day")


@register(
    "request_logs_after_pruning",
    LOGS + f"SELECT {LOG_SQL} FROM request_logs WHERE created_at >= TIMESTAMP '2024-04-10 15:00:00' - INTERVAL 90 DAY",
)
def _(spark, folder):
    log = _appended(spark, folder)
    log.prune(F.lit("2024-04-10 15:00:00").cast("timestamp"), operations.LOG_RETENTION_DAYS)
    return _log_rows(log).select(*LOG_COLUMNS)


@register(
    "blocked_request_anomalies",
    LOGS + """SELECT run_id, source, 'critical' AS severity, 'blocked_response' AS code, url,
 CAST(status_code AS VARCHAR) AS status_code FROM request_logs WHERE status_code IN (401, 403, 407, 429)""",
)
def _(spark, folder):
    rows = quality.blocked_requests(observed.request_logs(spark, folder))
    return rows.select("run_id", "source", "severity", "code", "url", F.col("metadata")["status_code"].alias("status_code"))


@register(
    "empty_run_anomalies",
    LOGS + """SELECT id AS run_id, source, 'zero_lots' AS code, concat(source, ' returned zero auction lots.') AS message
 FROM runs WHERE records_found // 400000 = 0""",
)
def _(spark, folder):
    counters = observed.runs(spark, folder).select(
        F.col("id").alias("run_id"), "source", "mode", F.expr("records_found div 400000").alias("records_found")
    )
    return quality.empty_runs(counters).select("run_id", "source", "code", "message")


@register(
    "missing_detail_anomalies",
    LOTS + """SELECT source, 'missing_detail_enrichment' AS code, 'warning' AS severity,
 concat(source, ' has ', count(*), ' persisted lots from this run without detail enrichment.') AS message
 FROM lots WHERE source = 'bring_a_trailer' AND detail_scraped_at IS NULL GROUP BY source HAVING count(*) > 0""",
)
def _(spark, folder):
    open_lots = observed.lots(spark, folder, vehicle=False).where(F.col("detail_scraped_at").isNull())
    return quality.undetailed_run(open_lots.select("id", "source")).select("source", "code", "severity", "message")


@register(
    "feed_event_counts",
    LOGS + """, told AS (
 SELECT source, CASE outcome WHEN 'success' THEN 'progress' WHEN 'blocked' THEN 'error' WHEN 'error' THEN 'error' ELSE 'warning' END AS event, created_at AS moment, 0 AS lots FROM request_logs
 UNION ALL SELECT source, CASE severity WHEN 'critical' THEN 'error' ELSE 'warning' END, created_at, 0 FROM anomalies
 UNION ALL SELECT source, 'start', started_at, 0 FROM runs
 UNION ALL SELECT source, CASE status WHEN 'success' THEN 'complete' ELSE 'error' END, finished_at, records_found FROM runs WHERE status <> 'running')
SELECT source, event, count(*) AS events, CAST(sum(lots) AS BIGINT) AS lots, CAST(max(moment) AS TIMESTAMP) AS last_at FROM told GROUP BY source, event""",
)
def _(spark, folder):
    logs = observed.request_logs(spark, folder).withColumn("parsed_lot_count", F.lit(0))
    runs = observed.runs(spark, folder)
    # Every run writes its record when it starts, and again when it has ended.
    begun = runs.withColumns({"status": F.lit("running"), "finished_at": F.lit(None).cast(runs.schema["finished_at"].dataType)})
    told = feed.events(logs, observed.anomalies(logs), begun.unionByName(runs))
    return feed.event_counts(told).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@register(
    "request_outcomes",
    LOGS + """SELECT id, CASE WHEN status_code IN (401, 403, 407, 429) THEN 'blocked' WHEN status_code < 400 THEN 'success'
  WHEN (status_code IS NULL OR status_code >= 500) AND attempt < 3 THEN 'retry' ELSE 'error' END AS outcome,
  coalesce(status_code IN (401, 403, 407, 429), FALSE) AS is_blocking FROM request_logs""",
)
def _(spark, folder):
    status, attempt = F.col("status_code"), F.col("attempt")
    return observed.request_logs(spark, folder).select(
        "id", urls.request_outcome(status, attempt).alias("outcome"), urls.is_blocking(status).alias("is_blocking")
    )


@register(
    "worker_totals",
    LOGS + """SELECT source, CAST(sum(records_found) AS BIGINT) AS records_found,
 CAST(sum(records_inserted) AS BIGINT) AS records_inserted FROM runs GROUP BY source""",
)
def _(spark, folder):
    return tallies.worker_totals(observed.runs(spark, folder))


@register(
    "epoch_days_of_orders",
    "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders",
)
def _(spark, folder):
    return observed.table(spark, folder, "orders").select(
        "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day")
    )
