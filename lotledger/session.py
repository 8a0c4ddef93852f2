"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings that change results or keep a plan bounded. Sizing settings
# (executors, memory, shuffle partitions) belong to the cluster and stay untouched.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A page far beyond the first ones is sorted by range instead of being held in
    # one heap per task and merged on the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to an existing session."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "lotledger", master: str | None = None, **conf: str) -> SparkSession:
    """Start a session; `conf` adds or overrides settings (use `_` for `.`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only where the cluster names none (tests, a laptop) a fresh local folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="lotledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
