"""Documents in units of a few megabytes, kept as a table bucketed by unit.

Operators that ask the corpus about every word window read the units several times. As the answers go to a unit and
the table is bucketed, texts never pass a shuffle; only questions and answers do, packed many to a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lotledger.llm.tables import ship, slices, store_path, texts_of
from lotledger.llm.words import raw, word_spans

ship(__name__)

UNIT_BYTES = 3 << 20


def _words(part: pa.RecordBatch) -> int:
    return int(word_spans(*raw(texts_of(part)))[2].sum())


def _units(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", most):
                rows = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit], pa.int64()), pa.array([_words(part)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)],
                    ["unit", "n_words", "rows"],
                )
                unit += 1

    return run


def in_units(docs: DataFrame, most: int = UNIT_BYTES) -> DataFrame:
    """unit, n_words, rows (all columns of docs): about `most` bytes of text in each unit, or one document."""
    spark = docs.sparkSession
    inner = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema.fields)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_units_{uuid.uuid4().hex}"
    units = docs.mapInArrow(_units(most), f"unit long, n_words long, rows array<struct<{inner}>>")
    units.write.bucketBy(buckets, "unit").option("path", store_path(spark, "units")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def rows_of(batch: pa.RecordBatch | pa.Table, k: int = 0) -> pa.RecordBatch:
    """The documents of the k-th unit of a batch."""
    rows = batch.column("rows")
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    first, last = rows.offsets[k].as_py(), rows.offsets[k + 1].as_py()
    own = rows.values.slice(first, last - first)
    return pa.RecordBatch.from_arrays(own.flatten(), [f.name for f in own.type])


def planes(values: np.ndarray, width: int | None = None) -> bytes:
    """The bytes of numbers, all first bytes, then all second ones, and so on: small numbers compress well. width: lower bytes only."""
    size = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T[: width or size].tobytes()


def unplanes(data: bytes, kind: type, width: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    own = np.frombuffer(data, np.uint8).reshape(width or size, -1)
    out = np.zeros((own.shape[1], size), np.uint8)
    out[:, : len(own)] = own.T
    return out.view(kind).ravel()


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as byte planes of their differences."""
    return planes(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def joined(blocks: list[bytes]) -> bytes:
    """Several blocks as one, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(blocks), *map(len, blocks)], np.int64).tobytes() + b"".join(blocks))


def parted(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    stops = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(data, np.int64, n, 8).tolist()])
    return [data[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
