"""Whole licences, their headers and SPDX lines; several licences of one file; frequencies of all words."""

from __future__ import annotations

import math
import textwrap

import pytest

from lotledger.llm import licenses

PROSE = "Der Hund lief über die Wiese und bellte. The harbour was quiet and the boats came in late. Nothing else was seen that day.\n"


def text(name):
    return dict(licenses.whole_texts())[name]


@pytest.fixture(scope="module")
def told(spark):
    headers = dict(licenses.HEADERS)
    files = [(100 + k, f"p/{k}", PROSE * (1 + k % 3) + f"word{k}") for k in range(60)]
    whole = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "MIT", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
    files += [(k, f"w/{k}", text(name)) for k, name in enumerate(whole)]
    files += [(20 + k, f"h/{k}", PROSE + "\n".join("# " + x for x in textwrap.wrap(headers[name], 60)) + "\nx = 1\n") for k, name in enumerate(["Apache-2.0", "GPL-3.0", "GPL-2.0", "MPL-2.0"])]
    files += [
        (30, "s/a", headers["Apache-2.0"]), (31, "s/b", "All rights reserved."), (32, "s/c", "// SPDX-License-Identifier: MIT\nint x;"),
        (33, "s/d", "// SPDX-License-Identifier: Zlib\nint x;"), (34, "s/e", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (35, "s/f", "The harbour was quiet and this work is released under the MIT License and the boats came in very late on that cold day"),
        (36, "s/g", "All rights reserved. No part of this work may be reproduced without permission."),
    ]
    found = licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()
    assert len(found) == len(files)
    return {r["file"]: r for r in found}, whole


def test_whole_texts_and_headers(told):
    rows, whole = told
    assert [rows[k]["licence"] for k in range(len(whole))] == whole
    assert [rows[20 + k]["licence"] for k in range(4)] == ["Apache-2.0", "GPL-3.0", "GPL-2.0", "MPL-2.0"]
    assert rows[30]["licence"] == "Apache-2.0" and rows[30]["cosine"] > 0.99


def test_lines(told):
    rows, _ = told
    assert rows[31]["licence"] == "Proprietary" and rows[31]["cosine"] == 1 and rows[36]["licence"] == "Proprietary"
    assert rows[32]["licence"] == "MIT" and rows[33]["licence"] is None and rows[35]["licence"] == "MIT"
    assert {x["licence"] for x in rows[34]["licences"]} >= {"MIT", "CC-BY-NC-4.0"}
    assert all(rows[100 + k]["licence"] is None and rows[100 + k]["licences"] == [] for k in range(60))


def test_cosine_by_hand(spark):
    files = [(1, "a", "Released under the MIT License today")] + [(k, f"b{k}", "today the sun is out") for k in range(2, 8)]
    found = {r["file"]: r for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()}
    weigh = lambda n: math.log(8 / (1 + n)) + 1
    notice = 4 * weigh(1) ** 2 + weigh(7) ** 2
    assert math.isclose(found[1]["cosine"], math.sqrt(notice / (notice + weigh(7) ** 2)), rel_tol=1e-8)
