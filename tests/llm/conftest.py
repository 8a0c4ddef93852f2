from __future__ import annotations

import pytest

LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(20000))
BASE = " ".join(f"word{i}" for i in range(60))
PASSAGE = " ".join(f"passage{i}" for i in range(20))
TEXTS = [
    None, "", " \t\n", "one two", "One  TWO", BASE, BASE + " tail", BASE.upper(), BASE + " again and again", LONG, LONG + " end",
    "begin " + PASSAGE + " first end", "other start " + PASSAGE + " second end", PASSAGE, "été naïve — ça va　",
    "a\x1cb\x85c ​ d'être it's  we'll   \n\n x", "same same same same same same same same same same same same same same same",
]


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars, and columns whose names operators use inside; ids repeat and are null."""
    out = [(i * 3, t) for i, t in enumerate(TEXTS)]
    out += [(6, TEXTS[5]), (15, TEXTS[5]), (15, TEXTS[5]), (None, BASE), (None, None), (100, BASE), (101, "begin " + PASSAGE + " first end")]
    return [(i, t, "en", f"src{(i or 0) % 2}", None if t is None else len(t), 1.5, "x", 7, b"y", True) for i, t in out]


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, label string, node long, digest binary, kept boolean"
)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
