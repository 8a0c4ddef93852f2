"""What the search for nearest vectors must not do: put copies of query blocks into the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.llm import topk


def test_query_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    vectors = {i: [float(i * 37 % 11), float(i * 53 % 7)] for i in range(60)}
    rows = topk.quantised(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    found = topk.search(rows, rows.where(F.col("vec_id") % 10 == 0), 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    whole = {i: [int(x * 256) for x in v] for i, v in vectors.items()}
    wanted = set()
    for q in range(0, 60, 10):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        wanted |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:3], 1)}
    assert {tuple(r) for r in found.collect()} == wanted
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
