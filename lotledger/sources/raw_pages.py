"""Raw pages: registering fetched content, content-addressed storage, reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.functions.maps import empty_map, merged
from lotledger.functions.urls import artifact_uri, canonical_url
from lotledger.schemas import DEFAULT_PRIORITY, RAW_PAGE_FIELDS, TARGET_PRIORITY, shaped

ADDRESS = ["source", "fetch_date", "content_sha256"]


def target_priority(target_type: Column) -> Column:
    chain = None
    for name, priority in TARGET_PRIORITY.items():
        test, value = target_type == name, F.lit(priority)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(DEFAULT_PRIORITY)


def register_pages(fetched: DataFrame) -> DataFrame:
    """Fetched pages as raw-page rows: canonical URL, content hash, size, address, priority.

    `fetched` has source, target_type, url, content, content_type, fetched_at and whatever
    else RAW_PAGE_FIELDS names; a page's own metadata wins over the computed priority.
    """
    digest = F.sha2(F.col("content"), 256)
    own = F.col("metadata") if "metadata" in fetched.columns else empty_map()
    priority = F.create_map(F.lit("target_priority"), target_priority(F.col("target_type")).cast("string"))
    named = fetched.withColumns({"content_sha256": digest, "canonical_url": canonical_url(F.col("url"))})
    page_id = (
        F.col("id")
        if "id" in fetched.columns
        else F.sha2(F.concat_ws("\u001f", "source", "url", "content_sha256", F.col("fetched_at").cast("string")), 256)
    )
    return shaped(
        named.withColumns(
            {
                "id": page_id,
                "size_bytes": F.octet_length("content"),
                "artifact_uri": artifact_uri(
                    F.col("source"), F.col("fetched_at"), F.col("content_sha256"), F.col("content_type")
                ),
                "metadata": merged(priority, own),
                "created_at": F.col("created_at") if "created_at" in fetched.columns else F.col("fetched_at"),
            }
        ),
        RAW_PAGE_FIELDS,
    )


def with_address(pages: DataFrame) -> DataFrame:
    return pages.withColumn("fetch_date", F.to_date("fetched_at"))


def new_artifacts(stored: DataFrame | None, pages: DataFrame) -> DataFrame:
    """Distinct contents of `pages` that the store does not hold yet.

    Content is compared by its hash only; the store is read for three short columns.
    """
    fresh = with_address(pages).groupBy(*ADDRESS).agg(
        F.min_by(F.struct("artifact_uri", "content_type", "size_bytes", "content"), "id").alias("_a")
    )
    rows = fresh.select(*ADDRESS, "_a.*")
    return rows if stored is None else rows.join(stored.select(*ADDRESS), ADDRESS, "left_anti")


def save_artifacts(spark: SparkSession, pages: DataFrame, folder: str) -> None:
    """Append new contents, one folder per source and day; what is there stays untouched."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = spark.read.parquet(folder) if files.exists(path) else None
    rows = new_artifacts(stored, pages)
    rows.write.mode("append").partitionBy("source", "fetch_date").parquet(folder)


def load_artifacts(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Pages with their stored content, found by address."""
    stored = spark.read.parquet(folder).select(*ADDRESS, "content")
    return with_address(pages).drop("content").join(stored, ADDRESS).drop("fetch_date")


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Page files (gzip or plain, below `folder`) as (uri, content), one row per file."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
