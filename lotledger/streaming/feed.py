"""Live figures over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.schemas import ANOMALY_FIELDS, REQUEST_LOG_FIELDS, RUN_FIELDS, ddl


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ddl(REQUEST_LOG_FIELDS)).parquet(folder)


def anomaly_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ddl(ANOMALY_FIELDS)).parquet(folder)


def run_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ddl(RUN_FIELDS)).parquet(folder)


def event_type(outcome: Column | str) -> Column:
    """Kind of feed event a request outcome stands for."""
    value = F.col(outcome) if isinstance(outcome, str) else outcome
    return (
        F.when(value == "success", "progress").when(value.isin("blocked", "error"), "error").otherwise("warning")
    )


def feed_counts(logs: DataFrame) -> DataFrame:
    """Running number of events per source and kind, for batch frames and streams alike."""
    return logs.groupBy("source", event_type("outcome").alias("event")).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.coalesce("parsed_lot_count", F.lit(0))).alias("lots"),
        F.max("created_at").alias("last_at"),
    )


def daily_counts(logs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests per source and day; days close once the watermark has passed them."""
    stamped = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        stamped.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day"), "source")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.to_date("window.start").alias("day"), "source", "requests")
    )


def run_events(runs: DataFrame, delay: str = "2 days") -> DataFrame:
    """One start and one ending per run, however often its record is written (while it runs, when it ends, again on a retry).

    A stream remembers a run for `delay` of event time; records older than that are late and tell nothing new.
    """
    ended = F.col("status")
    ending = F.when(ended == "success", "complete").when(ended == "cancelled", "warning").when(ended == "error", "error")
    told = F.when(ended == "error", F.concat(F.lit("Run failed: "), F.coalesce("error", F.lit("unknown")))).otherwise(
        F.concat(F.lit("Run ended: "), ended)
    )
    both = F.array(
        F.struct(F.lit("start").alias("event"), F.col("started_at").alias("at"), F.concat(F.lit("Run started: "), "source").alias("message"), F.lit(0).alias("lots")),
        F.struct(ending.alias("event"), F.coalesce("finished_at", "started_at").alias("at"), told.alias("message"), F.col("records_found").alias("lots")),
    )
    rows = runs.select("source", F.col("id").alias("run_id"), F.inline(both)).where(F.col("event").isNotNull())
    dated = rows.withColumn("at", F.col("at").cast("timestamp"))
    key = ["source", "run_id", "event"]
    if not dated.isStreaming:
        return dated.dropDuplicates(key)
    return dated.withWatermark("at", delay).dropDuplicatesWithinWatermark(key)


def events(logs: DataFrame, anomalies: DataFrame, runs: DataFrame, delay: str = "2 days") -> DataFrame:
    """The feed: what requests, anomalies and runs tell, as source, run_id, event, at, message and lots.

    The kinds are start, progress, warning, error and complete. All three may be streams, or all frames. A run's lots are those of its
    requests again, so its ending carries the total it found.
    """
    at = F.col("created_at").cast("timestamp").alias("at")
    asked = logs.select(
        "source", "run_id", event_type("outcome").alias("event"), at, F.concat_ws(" ", "outcome", "url").alias("message"),
        F.coalesce("parsed_lot_count", F.lit(0)).alias("lots"),
    )
    odd = anomalies.select(
        "source", "run_id", F.when(F.col("severity") == "critical", "error").otherwise("warning").alias("event"), at, "message", F.lit(0).alias("lots")
    )
    return asked.unionByName(odd).unionByName(run_events(runs, delay))


def event_counts(feed: DataFrame) -> DataFrame:
    """Running number of events per source and kind, with their lots and the latest time."""
    return feed.groupBy("source", "event").agg(
        F.count(F.lit(1)).alias("events"), F.sum("lots").alias("lots"), F.max("at").alias("last_at")
    )
