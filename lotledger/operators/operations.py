"""Operations console: run health, latest rows per source, counts per run, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.schemas import ACTIVE_SOURCES

STALE_HOURS = 36
LOG_RETENTION_DAYS = 90


def latest(df: DataFrame, key: str, when: str, columns: list[str]) -> DataFrame:
    """Newest row per key; equal times go to the highest id. Combines on the map side."""
    rest = [c for c in columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(when, "id")).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_runs(runs: DataFrame) -> DataFrame:
    columns = ["source", "id", "status", "started_at", "finished_at", "records_found", "records_inserted",
               "records_updated"]
    return latest(runs, "source", "started_at", columns)


def latest_successes(runs: DataFrame) -> DataFrame:
    found = latest(
        runs.where(F.col("status") == "success"), "source", "started_at", ["source", "id", "finished_at"]
    )
    return found.select("source", "id", F.col("finished_at").alias("last_success_at"))


def latest_anomalies(anomalies: DataFrame) -> DataFrame:
    columns = ["source", "id", "severity", "code", "message", "created_at"]
    return latest(anomalies, "source", "created_at", columns)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in ACTIVE_SOURCES], "source string")


def source_health(runs: DataFrame, anomalies: DataFrame, now: Column) -> DataFrame:
    """One row per source: running, error, stale or idle, tested in this order."""
    run = latest_runs(runs).withColumnRenamed("status", "latest_status")
    success = latest_successes(runs).select("source", "last_success_at")
    anomaly = latest_anomalies(anomalies).select(
        "source", F.col("severity").alias("latest_anomaly_severity"), F.col("message").alias("latest_anomaly_message")
    )
    joined = (
        sources(runs.sparkSession)
        .join(run.drop("id", "finished_at"), "source", "left")
        .join(success, "source", "left")
        .join(anomaly, "source", "left")
    )
    cutoff = now - F.make_dt_interval(hours=F.lit(STALE_HOURS))
    stale = F.col("last_success_at").isNull() | (F.col("last_success_at") < cutoff)
    state = (
        F.when(F.col("latest_status") == "running", "running")
        .when(F.col("latest_status") == "error", "error")
        .when(stale, "stale")
        .otherwise("idle")
    )
    return joined.select(
        "source",
        state.alias("state"),
        F.col("started_at").alias("last_run_at"),
        "last_success_at",
        "latest_status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records_found", "records_inserted", "records_updated")],
        "latest_anomaly_severity",
        "latest_anomaly_message",
        stale.alias("is_stale"),
    )


def counts_per_run(runs: DataFrame, logs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Runs with the number of their request logs, failed requests and anomalies."""
    failed = F.col("outcome").isin("error", "blocked")
    per_log = logs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("request_count"), F.count(F.when(failed, True)).alias("failed_count")
    )
    per_anomaly = anomalies.groupBy("run_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    zero = F.lit(0).cast("long")
    return (
        runs.withColumn("run_id", F.col("id"))
        .join(per_log, "run_id", "left")
        .join(per_anomaly, "run_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("request_count", "failed_count", "anomaly_count")})
        .drop("run_id")
    )


def children(parents: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Parents with their child rows, flat; parents without any keep one row of NULLs."""
    return parents.join(rows.select(F.col(key).alias("_parent"), *columns), F.col("id") == F.col("_parent"), "left").drop(
        "_parent"
    )


def within_retention(logs: DataFrame, now: Column, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    """Logs that are not older than the retention time."""
    return logs.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
