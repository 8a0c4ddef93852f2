"""Language identification: kernel and regression against brute force, odd texts, held-out accuracy."""

from __future__ import annotations

import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from lotledger.llm import language

SYLLABLES = {"aa": ["th", "ing", "on", "er", "wh"], "bb": ["ció", "ña", "que", "ll", "os"], "cc": ["ü", "sch", "ver", "ein", "ß"]}


def letters(text):
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def grams(text):
    own = letters(text)
    return {own[i : i + n] for n in language.ORDERS for i in range(len(own) - n + 1)} if any(c.isalpha() for c in own) else set()


def some(lang, seed, n=30):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, some(lang, 7 * k), lang) for k in range(240) for lang in [("aa", "bb", "cc")[k % 3]]]
    rows += [(1000 + k, rows[0][1], "aa") for k in range(100)]  # copies
    rows += [(2000, rows[1][1] * 2000, "bb"), (2001, None, "aa"), (2002, "", None), (2003, " 12 \t!! ", "bb"), (None, some("cc", 5), "cc"), (2004, some("cc", 6), None)]
    rows += [(2005, some("aa", 9), "aa")] * 2
    frame = spark.createDataFrame([(*r, 0.5, "x", True) for r in rows], "doc_id long, text string, lang string, score double, lang_pred string, hash boolean")
    return frame.repartition(3), rows


def test_spectrum_is_the_set_of_grams(monkeypatch):
    for text in ("", "12 !?", "a", "Ab  c--D", "漢字 ÉÉ\n\nx", some("bb", 1), "İ ı ß ſ"):
        own = language.spectrum(text)
        assert abs(len(own) - len(grams(text))) < 2 and (np.diff(own) > 0).all()
    long = some("cc", 2, 4000)
    whole = language.spectrum(long)
    monkeypatch.setattr(language, "PART", 1000)
    assert (language.spectrum(long) == whole).all()


def test_kernel_is_brute_force():
    texts = [some(lang, k) for k in range(3) for lang in SYLLABLES]
    model = language.Model(["x"], [language.spectrum(t) for t in texts], np.zeros((len(texts), 1)))
    values = model.kernel(model.landmarks, model._presence())
    for i, a in enumerate(map(grams, texts)):
        for j, b in enumerate(map(grams, texts)):
            assert abs(values[i, j] - len(a & b) / math.sqrt(len(a) * len(b))) < 0.01  # an n-gram in a million shares its number


def test_all_landmarks_give_kernel_ridge_regression():
    texts = {lang: [language.spectrum(some(lang, k, 8)) for k in range(6)] for lang in SYLLABLES}
    model = language.train(texts, 18)
    kernel = model.kernel(model.landmarks, model._presence()).astype(np.float64)
    wanted = np.where(np.repeat(np.arange(3), 6)[:, None] == np.arange(3), 1.0, -1.0)
    exact = kernel @ np.linalg.solve(kernel + 6 * language.RIDGE * np.eye(18), wanted)
    assert np.abs(model.decide(model.landmarks) - exact).max() < 1e-3


def test_every_row_and_held_out_accuracy(labelled):
    frame, rows = labelled
    found = language.identify(frame).collect()
    assert len(found) == len(rows)
    told = {r["doc_id"]: r for r in found}
    for i, text, lang in rows:
        r = told[i]
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == ("cc" if lang is None else lang)


def test_held_out_rows_and_copies_are_not_learnt(labelled):
    frame, rows = labelled
    learnt = language.sample(frame)
    known = [(t, x) for i, t, x in rows if i is None or zlib.crc32(str(i).encode()) % 4 != 2]
    want = {lang: {t for t, x in known if x == lang and any(c.isalpha() for c in t or "")} for lang in SYLLABLES}
    assert {lang: len(own) for lang, own in learnt.items()} == {lang: len(own) for lang, own in want.items()}
    few = language.sample(frame, 30)
    assert set(few) == set(SYLLABLES) and all(0 < len(own) <= 10 for own in few.values())


def test_nothing_to_learn(spark, nothing):
    assert language.identify(nothing).count() == 0
    unknown = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(unknown).collect()} == {("und", 0.0)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="tables are not here")
def test_held_out_accuracy_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(told) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.97
