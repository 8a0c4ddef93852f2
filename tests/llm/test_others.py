"""Conversations, vectors, the registered queries and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lotledger.llm import chat, topk
from lotledger.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")

TURNS = [
    (1, 0, "user", "hi <|end|> &amp; </s>"), (1, 1, "user", None), (1, 2, "assistant", "a<"), (1, 3, "assistant", "|b [INST]"), (1, 3, "assistant", "|b [INST]"),
    (2, None, None, "<"), (2, 0, "assistant", ""), (None, 5, "<|turn|>", "\\Q<<SYS>>"), (3, 0, "assistant", "é" * 3),
    *[(4, k, "user" if k % 7 < 5 else "assistant", f"t{k}") for k in range(40)],
]


@pytest.mark.parametrize("part", [256, 4])
def test_chat_reads_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_TURNS", part)
    told = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, parts int").repartition(3)
    formatted = chat.format_conversations(told)
    read = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    for conv, own in itertools.groupby(sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")), lambda t: t[0]):
        own = [(t[2] or "", t[3] or "") for t in own]
        assert [(t["role"], t["text"]) for t in read[conv]["turns"]] == own
        assert read[conv]["loss_text"] == "".join(x for r, x in own if r == "assistant")
        assert whole[conv].count(chat.OPEN) == len(list(itertools.groupby(own, lambda t: t[0])))
    assert "[INST]" not in whole[1] and "</s>" not in whole[1]
    digest = {r["conv_id"]: r for r in chat.digests(chat.read_back(formatted)).collect()}
    assert digest[3]["turns_sha256"] == hashlib.sha256("assistant\nééé\n".encode()).hexdigest() and digest[3]["loss_chars"] == 3
    assert chat.digests(chat.read_back(chat.format_conversations(told.limit(0)))).count() == 0


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 40)).astype(np.float32)
    vectors[50:120] = vectors[50]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(301, None), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")]), (None, [1.0]), (305, []), (306, [1e30]), (7, rows[7][1])]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    known = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = topk.search(known, known.where("vec_id % 50 = 0"))
    ints = {i: [int(np.floor(np.float64(x) * 256)) for x in v] for i, v in rows if i is not None and i < 300}
    ints[305] = []
    want = []
    for q in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in [*ints.items(), (7, ints[7])] if i != q)
        far = min(max(ints[q][0] * int(9.2e18), -(2**63)), 2**63 - 1)
        scores = sorted([*scores, (-far, 306)])
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r)[:3] for r in found.collect()) == [w[:3] for w in want]
    assert topk.search(known.limit(0), known.limit(0)).count() == 0
    two = known.where("vec_id < 2")
    assert topk.search(two, two.where("vec_id = 0")).count() == 1


def test_topk_counts_every_row_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    rows = [(50, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.0]), (1, [3.0, 0.0]), (50, [4.0, 0.0])]
    known = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2))
    found = sorted(tuple(r) for r in topk.search(known, known.where("vec_id % 50 = 0"), 3).collect())
    want = []
    for q, (i, v) in enumerate(rows):
        if i == 50:
            best = sorted((-int(256 * v[0]) * int(256 * w[0]), j) for c, (j, w) in enumerate(rows) if c != q)[:3]
            want += [(50, rank, j, -score) for rank, (score, j) in enumerate(best, 1)]
    assert found == sorted(want)


@needs_data
@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_sql(spark, name):
    base = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        base.execute(f"create view {file.stem} as select * from '{file}'")
    want = base.execute(REGISTRY.sql[name])
    columns = [c[0] for c in want.description]
    have = [tuple(r) for r in REGISTRY.queries[name](spark, FOLDER).select(*columns).collect()]
    assert sorted(have) == sorted(want.fetchall())


def test_names():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"}


def test_pipeline_stages(spark, docs, nothing, tmp_path):
    for name, rows in (("docs", docs), ("nothing", nothing)):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            new = stage(spark, now, folder)
            assert k == len(corpus_pipeline.STAGES) - 1 or new.columns == docs.columns
            new.write.parquet(f"{folder}/{k}.parquet")
            now = spark.read.parquet(f"{folder}/{k}.parquet")
        assert corpus_pipeline.run(spark, folder).count() == now.count()
        assert (now.count() > 0) == (name == "docs")
