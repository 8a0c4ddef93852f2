"""The pipeline's near_dedup stage links from 0.80 on, the operator alone from 0.85 on."""

from __future__ import annotations

import corpus_pipeline
import pytest

from lotledger.llm import near_dedup


def shingles(text):
    own = text.split()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def like(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def body(name, n, *changed):
    return " ".join(f"{name}x{i}" if i in changed else f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def pairs(spark):
    texts = []
    for name, n, changed in (("p", 104, (10, 30)), ("q", 484, (9, 60, 120, 180, 240, 300, 360, 420, 440, 460)), ("r", 104, (10, 30, 50)), ("s", 84, (10,)), ("t", 11, (10,)), ("u", 13, (12,))):
        texts += [body(name, n), body(name, n, *changed)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [like(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True)]


def test_stage_links_from_80_on(spark, pairs):
    docs, likes = pairs
    assert sum(0.80 <= x < 0.85 for x in likes) >= 2 and any(x < 0.80 for x in likes) and any(x >= 0.85 for x in likes)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(len(likes))} | {2 * k + 1 for k, x in enumerate(likes) if x < 0.80}


def test_operator_links_from_85_on(pairs):
    docs, likes = pairs
    found = {r["doc_id"]: r["kept"] for r in near_dedup.near_copies(docs).collect()}
    assert [found[2 * k + 1] for k in range(len(likes))] == [x < 0.85 for x in likes]


def test_chance_of_a_miss():
    assert (near_dedup.fewest(85), near_dedup.fewest(80)) == (32, 30)


def test_open_groups_at_80(spark):
    """Members far from the centre of their lists but near each other are linked at 80 as well."""
    core, texts = [f"c{i}" for i in range(200)], []
    for k in range(30):
        changed = list(core)
        for j in range(k % 8):
            changed[(37 * k + 31 * j) % 200] = f"e{k}x{j}"
        texts += [" ".join(changed), " ".join([*changed, f"t{k}"])]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if like(texts[a], texts[b]) >= 0.8:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    found = near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80)
    assert [tuple(r) for r in found.orderBy("doc_id").select("doc_id", "component_id").collect()] == list(enumerate(group))
