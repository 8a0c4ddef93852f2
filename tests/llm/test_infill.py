"""Fill-in-middle: outputs against brute force, exact round trips, frames that move whole."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotledger.llm import infill

LONG = "".join(chr(97 + i % 26) if i % 7 else "é漢😀 <"[i % 5] for i in range(3 * infill.FRAME_UNITS + 77))


def brute(doc_id, text):
    told = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(told[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((one % (n + 1), two % (n + 1)))
    digest = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(m in text for m in infill.MARKS) or three % 100 >= 90:
        return doc_id, n, "plain", None, None, digest, digest
    if four % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, form, a, b - a, hashlib.sha256(out.encode()).hexdigest(), digest


def framed(text):
    store = infill.Frames()
    store.write(text)
    return store


def whole(store):
    return b"".join(store.stream()).decode()


def test_digests(spark, docs, rows, nothing):
    odd = ["<P>", "x <S> y", "a<M", "<", ">P<S", "<P<", LONG, LONG[: infill.FRAME_UNITS], LONG[: infill.FRAME_UNITS + 1]]
    more = [(1000 + 31 * k + j, t) for j, t in enumerate(odd) for k in range(12)] + [(None, "<<>>")] + [(7, "ab")] * 2
    told = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs, allowMissingColumns=True).repartition(3)
    want = [brute(i, t or "") for i, t, *_ in [*rows, *more]]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    found = infill.digests(infill.transformed(told))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert infill.digests(infill.transformed(nothing)).count() == 0


def test_texts_come_back(docs, rows):
    outputs = infill.transformed(docs)
    back = infill.texts(infill.restored(outputs)).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert all(r["text"].startswith(infill.MARKS) for r in infill.texts(outputs.where("form <> 'plain'")).collect())


def test_whole_frames_move_as_they_are(monkeypatch):
    source = framed(LONG)
    read = []
    monkeypatch.setattr(infill.Frames, "data", lambda self, k, f=infill.Frames.data: read.append(k) or f(self, k))
    out = infill.arrange(source, "psm", 100, infill.FRAME_UNITS + 5)
    assert set(read) == {0, 1}
    assert source.frame(2) in (out.frame(k) for k in range(len(out.units)))


@pytest.mark.parametrize("form", ["psm", "spm"])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé😀<PSM>", max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_round_trip(form, text, one, two):
    if any(m in text for m in infill.MARKS):
        return
    first, second = sorted((min(one, len(text)), min(two, len(text))))
    kept, infill.FRAME_UNITS = infill.FRAME_UNITS, 4
    try:
        source = framed(text)
        assert whole(source) == text and source.n == len(text)
        output = infill.arrange(source, form, first, second)
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        assert whole(output) == (f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")
        assert whole(infill.restore(output, form)) == text
    finally:
        infill.FRAME_UNITS = kept
