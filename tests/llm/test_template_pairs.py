"""Pairs whose bands are all held by texts far from both are found."""

from __future__ import annotations

from lotledger.llm import fingerprints


def shingles(text):
    own = text.split()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def grouped(n, pairs):
    group = list(range(n))
    for a, b in pairs:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = [new if g == old else g for g in group]
    return group


def test_pairs_behind_a_template(spark):
    template = " ".join(f"t{i}" for i in range(394))

    def tail(name, n):
        return " ".join(f"{name}w{i}" for i in range(n))

    texts = [f"{template} {tail(f'e{k}', 55)}" for k in range(40)]
    for k in range(12):
        texts += [f"{template} {tail(f'p{k}', 8)} {tail(f'{side}{k}', 47)}" for side in "xy"]
    texts.append(texts[45].upper())
    sets = [shingles(t.lower()) for t in texts]
    near = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len([1 for a, b in near if b < 64]) == 12
    rows = [*enumerate(texts), (None, texts[3]), (None, tail("z", 60)), (None, tail("z", 60) + " end")]
    found = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = [(r["a"], r["b"]) for r in found if r["b"] is not None]
    assert grouped(len(texts), told) == grouped(len(texts), near) and set(told) <= set(near)
    assert {(r["a"], r["b"]) for r in found if r["b"] is None} == {(3, None), (None, None)}
    for r in found:
        if r["b"] is not None:
            assert r["jaccard"] == len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]])
