"""Reading tables, keeping intermediate tables, and shipping functions to the workers."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from lotledger.session import shared_folder


def ship(module_name: str) -> None:
    """Functions of this module travel to the workers as code, not as an import."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a written table in the folder all executors share.

    Cuts the lineage: a lost executor costs a read of files, not the work before.
    """
    path = store_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all tasks it runs."""
    holder = sys.modules.setdefault("_lotledger_worker", types.ModuleType("_lotledger_worker"))
    return holder.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    first, size = 0, 0
    for k, n in enumerate(lengths):
        if size + n > most and k > first:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if first < len(lengths):
        yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with empty texts for nulls."""
    return pc.fill_null(batch.column(column), "")
