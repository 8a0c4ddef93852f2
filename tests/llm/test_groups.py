"""Large groups of near copies: pairs in proportion, no link lost, one row of each component kept."""

from __future__ import annotations

import numpy as np
import pytest

from lotledger.llm import near_dedup


def shingles(text):
    own = text.split()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def copies(n, most, seed=3, base=False):
    """Texts of 300 words, each with some words of its own."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)] if base else []
    for k in range(n):
        own = list(words)
        for place in rng.choice(300, int(rng.integers(most[0], most[1] + 1)), replace=False):
            own[place] = f"x{k}y{place}"
        texts.append(" ".join(own))
    return texts


def components(texts, percent):
    sets = [shingles(t) for t in texts]
    number = {v: k for k, v in enumerate(set().union(*sets))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for row, own in enumerate(sets):
        held[row, [number[v] for v in own]] = 1
    both = held @ held.T
    size = held.sum(1)
    near = 100 * both >= percent * (size[:, None] + size - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(near, label, len(sets)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize(("percent", "most"), [(80, (2, 5)), (85, (1, 4))])
def test_pairs_in_proportion(spark, monkeypatch, percent, most):
    tested = []
    whole = near_dedup._Texts.of_both
    monkeypatch.setattr(near_dedup._Texts, "of_both", lambda self, pairs: tested.append(pairs.count()) or whole(self, pairs))
    number = {}
    for n in (100, 400):
        tested.clear()
        texts = copies(n, most)
        found = near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent)
        assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == components(texts, percent)
        number[n] = sum(tested)
    assert number[400] <= 8 * number[100]


def test_groups_around_several_bases(spark):
    """Bases that share passages, far members and members near each other but not near the centre."""
    rng = np.random.default_rng(9)
    texts = []
    passage = " ".join(f"p{i}" for i in range(150))
    for b in range(4):
        body = [f"b{b}w{i}" for i in range(150)]
        for k in range(40):
            own = list(body)
            for place in rng.choice(150, k % 12, replace=False):
                own[place] = f"b{b}k{k // 5}x{place}"
            texts.append(f"{' '.join(own)} {passage if k % 3 else ''} {'tail ' * (k % 4)}")
    for percent in (80,):
        found = near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent)
        assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == components(texts, percent)


def test_one_row_of_each_component_stays(spark):
    a, b = copies(2, (1, 1))
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (4, other, 4), (4, other, 5), (4, other + " end", 6), (9, other, 7), (None, "", 8), (None, "", 9), (None, None, 10), (5, " ", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    kept = near_dedup.without_copies(docs, 80)
    assert kept.columns == docs.columns
    told = [tuple(r) for r in kept.collect()]
    assert len([r for r in told if r[2] <= 3]) == 1 and len([r for r in told if 4 <= r[2] <= 7]) == 1
    assert {r[2] for r in told if r[2] > 7} == {8, 9, 10, 11}
    assert [r[0] for r in told if 4 <= r[2] <= 7] == [4]
