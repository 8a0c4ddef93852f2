"""Collocations against brute force: pieces, languages, cuts, contained phrases, ties, collisions."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from lotledger.llm import collocations, words


def brute(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            own = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for size in range(1, 6):
                for i in range(len(own) - size + 1):
                    counts[lang][tuple(own[i : i + size])] += 1
    out = []
    for lang, seen in counts.items():
        found = []
        candidates = {g: a for g, a in seen.items() if len(g) > 1 and a >= least}
        gone = {
            g[i : i + size] for g, a in candidates.items() for size in range(2, len(g)) for i in range(len(g) - size + 1) if a >= candidates.get(g[i : i + size], a + 1)
        }
        for g, a in candidates.items():
            if g not in gone:
                score, k = min((1000 * a * totals[lang] // (seen[g[:k]] * seen[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), seen[g[:k]], seen[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def told(docs, rows):
    rng = np.random.default_rng(5)
    vocabulary = ["The", "the", "of", "é", "漢字", "a\x1cb", "x1", "end", "\xa0", "new", "york", "city", "hall"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\x0b"]
    texts = [r[1] for r in rows]
    for _ in range(60):
        texts.append("".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.integers(1, 90))))
    texts += ["new york city hall is new york city hall"] * 9 + ["one two three four five six seven"] * 7 + [".,;", "\n"]
    langs = [("en", "fr", None, "")[k % 4 if k % 3 else 0] for k in range(len(texts))]
    return [(lang, text) for lang, text in zip(langs, texts, strict=True)]


@pytest.mark.parametrize(("least", "top", "unit"), [(3, 2000, 1 << 12), (7, 5, 1 << 22)])
def test_against_brute_force(spark, told, monkeypatch, least, top, unit):
    monkeypatch.setattr(collocations, "LEAST", least)
    monkeypatch.setattr(collocations, "UNIT_BYTES", unit)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 512)
    monkeypatch.setattr(collocations, "MERGED", 2)
    frame = spark.createDataFrame([(t, x, 1, "u", b"k") for x, t in told], "text string, lang string, unit long, phrase string, keys binary").repartition(3)
    want = brute(told, least, top)
    assert len(want) > 10 and len({w[0] for w in want}) > 2
    assert found(collocations.collocations(frame, top)) == want


def test_nothing(spark, nothing):
    assert collocations.collocations(nothing).count() == 0
    empty = spark.createDataFrame([(None, None), ("", "en"), (" \t.", "fr")], "text string, lang string")
    assert collocations.collocations(empty).count() == 0


def test_equal_fingerprints_are_told_apart(spark, told, monkeypatch):
    """With fingerprints of a few bits, phrases collide all the time; counts stay exact."""
    monkeypatch.setattr(collocations, "LEAST", 4)
    monkeypatch.setattr(collocations, "mixed", lambda x: words.mixed(x) & np.uint64(0xF800000000000000))
    frame = spark.createDataFrame(told, "lang string, text string").repartition(2)
    assert found(collocations.collocations(frame)) == brute(told, 4, 2000)


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**15
    counts = [("en", 0, None, 10**16), ("en", 1, "x", big), ("en", 1, "y", big + 7), ("en", 2, "x y", big - 11)]
    row = collocations.scored(spark.createDataFrame(counts, "lang string, size int, phrase string, a long")).first()
    assert row["score"] == 1000 * (big - 11) * 10**16 // (big * (big + 7))
