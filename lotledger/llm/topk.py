"""Exact top-k search by integer inner product: columnar branch and bound.

Vectors become integers floor(256 x) and get a row number. Candidates are dealt into blocks, queries into blocks, and every
pair of blocks is one cell of work; a candidate block is copied once for `TOGETHER` query blocks, a query block once for each candidate block. In a cell the candidates lie dimension by dimension; scores are summed up
block of dimensions by block, and after each one the candidates whose score cannot reach the k-th best any more
(Cauchy-Schwarz on the remaining dimensions) are dropped and the rest compacted.

Vectors that are null or hold a null or non-finite component take no part. Vectors of unequal length count as
filled up with zeros; an empty vector scores 0. Ties go to the smaller id. Every row counts, also where an id repeats: a query leaves out
its own row only, and a repeated query id has as many answers of its own as it has rows. Null ids take no part. Scores beyond 64 bits are cut to the 64-bit range. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, stored

ship(__name__)

CANDIDATE_BLOCK, QUERY_BLOCK, TOGETHER, DIMENSIONS = 8192, 512, 16, 16


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """row (a number of its own), vec_id, vector of integers, as a stored table."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        embeddings.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .where(F.coalesce(finite, F.lit(False)))
        .select("vec_id", F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(9.2e18)), F.lit(-9.2e18)))).alias("vector"))
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    )
    return stored(rows, "vectors")


def _packed(batches: Iterator[pa.RecordBatch] | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.stack([batches.column(c).to_numpy() for c in ("vec_id", "row")])
    rows = batches.column("vector").combine_chunks()
    lengths = np.diff(rows.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = rows.flatten().to_numpy()
    return ids, out


def _block(group: pa.Table) -> pa.Table:
    """One row: all ids and row numbers, and all vectors in vertical layout."""
    ids, rows = _packed(group)
    order = np.lexsort(ids[::-1])
    ids, rows = np.ascontiguousarray(ids[:, order]), rows[order]
    return pa.table({
        "block": group.column("block").slice(0, 1).cast(pa.int64()),
        "ids": pa.array([ids.tobytes()], pa.binary()),
        "columns": pa.array([np.ascontiguousarray(rows.T).tobytes()], pa.binary()),
    })


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in Python integers, cut to 64 bits; for components too large for doubles."""
    out = a.astype(object) @ b.astype(object)
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_cell(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, columns: np.ndarray, k: int) -> tuple[list, list, list, list]:
    """The k best candidates of each query: its id and row number, vec_id, score.

    q_ids, c_ids: ids and row numbers; queries: rows by dimensions; columns: dimensions by candidates, ids ascending.
    """
    width = min(queries.shape[1], len(columns))
    queries, columns = queries[:, :width], columns[:width]
    found: tuple[list, list, list, list] = ([], [], [], [])
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(width, 1)
    small = largest < 2**52
    if small:
        queries, columns = queries.astype(np.float64), columns.astype(np.float64)
        edges = [*range(0, width, DIMENSIONS), width] if width else [0]
        rest_c = [np.sqrt((columns[e:] ** 2).sum(0)) for e in edges[1:]]
        rest_q = [np.sqrt((queries[:, e:] ** 2).sum(1)) for e in edges[1:]]
        first = queries[:, : DIMENSIONS] @ columns[:DIMENSIONS]
    for i, (own, own_row) in enumerate(q_ids.T.tolist()):
        live = np.flatnonzero(c_ids[1] != own_row)
        if not small:
            score = _exact(queries[i : i + 1], columns[:, live])[0]
        else:
            score = first[i][live]
            for b in range(len(edges) - 1):
                if b:
                    score = score + queries[i, edges[b] : edges[b + 1]] @ columns[edges[b] : edges[b + 1], live]
                if len(live) > k and b < len(edges) - 2:
                    reach = rest_q[b][i] * rest_c[b][live] * (1 + 1e-9) + 1e-6
                    floor = np.partition(score - reach, len(live) - k)[len(live) - k]
                    keep = score + reach >= floor
                    live, score = live[keep], score[keep]
        best = np.lexsort((c_ids[0, live], -score.astype(np.int64) if small else ~score))[:k]
        found[0].extend([own] * len(best))
        found[1].extend([own_row] * len(best))
        found[2].extend(c_ids[0, live[best]].tolist())
        found[3].extend(score[best].astype(np.int64).tolist())
    return found


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: np.frombuffer(batch.column(name)[row].as_buffer(), np.int64)  # noqa: B023, E731
                q_ids, c_ids = get("q_ids").reshape(2, -1), get("ids").reshape(2, -1)
                q = get("q_columns").reshape(-1, q_ids.shape[1]).T
                found = search_cell(q_ids, q, c_ids, get("columns").reshape(-1, c_ids.shape[1]), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "query_row", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query but its own row.

    vectors: as `quantised` gives them; queries: some of these rows. Blocks have a bounded size whatever the number of rows is.
    """
    shape = "block long, ids binary, columns binary"

    def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-rows.count() // size))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
        return dealt.groupBy("block").applyInArrow(_block, shape), n

    cand, n_cand = blocks(vectors, CANDIDATE_BLOCK)
    asked, n_asked = blocks(queries, QUERY_BLOCK)
    groups = -(-n_asked // TOGETHER)
    cand = cand.withColumn("together", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.select(
        F.pmod("block", F.lit(groups)).cast("int").alias("together"), F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"),
        F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("block"),
    )
    # Copies of the query blocks outgrow what is known of their size before; a broadcast would put them all into the driver.
    best = cand.join(asked.hint("merge"), ["block", "together"]).select("q_ids", "q_columns", "ids", "columns").mapInArrow(
        _cells(k), "query_id long, query_row long, vec_id long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
