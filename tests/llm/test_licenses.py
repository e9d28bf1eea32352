"""Licence notices against a plain edit-distance scan; relations of licences; long texts full of notices."""

from __future__ import annotations

import random
import time

import pytest

from geosieve.llm import license_scan
from geosieve.llm.license_scan import NOTICES, edits_of, find_notices, normal, scan_licenses
from tests.llm.test_operators import by_id


def ends_within(notice: str, text: str, limit: int) -> dict[int, int]:
    """Places where the notice ends with at most ``limit`` edits, and their number (one column of the table at a time)."""
    column, out = list(range(len(notice) + 1)), {}
    for end, ch in enumerate(text, 1):
        left, column = column, [0]
        for i, x in enumerate(notice, 1):
            column.append(min(left[i - 1] + (x != ch), left[i] + 1, column[-1] + 1))
        if column[-1] <= limit:
            out[end] = column[-1]
    return out


def distance(a: str, b: str) -> int:
    column = list(range(len(a) + 1))
    for ch in b:
        left, column = column, [column[0] + 1]
        for i, x in enumerate(a, 1):
            column.append(min(left[i - 1] + (x != ch), left[i] + 1, column[-1] + 1))
    return column[-1]


def damaged(notice: str, edits: int, r: random.Random) -> str:
    text = list(notice)
    for _ in range(edits):
        at = r.randrange(1, len(text) - 1)
        text[at:at + r.randint(0, 1)] = r.choice(["q", "", "z", " "])
    return "".join(text)


def test_notices_by_edit_distance():
    r, notices = random.Random(4), tuple(NOTICES.items())
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            notice = r.choice(notices)[0]
            parts += [" ".join(r.choice(["free", "license", "the", "copy", "w"]) for _ in range(r.randrange(6))),
                      damaged(notice, r.randint(0, edits_of(notice) + 3), r)]
        text = normal(" ".join(parts).encode())
        found = find_notices(text, notices)
        for i, begin, end, edits in found:
            assert distance(notices[i][0], text[begin:end]) == edits <= edits_of(notices[i][0])
        for i, (notice, _) in enumerate(notices):
            # wherever the notice ends within the bound, a span of it is found there
            for end in ends_within(notice, text, edits_of(notice)):
                reach = edits_of(notice)
                assert any(f[0] == i and f[1] < end and f[2] > end - len(notice) - reach for f in found), (notice, text)


RELATIONS = {
    "Creative Commons Attribution 4.0 International": "cc-by",
    "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc",
    "the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 licence": "cc-by-nc-sa",
    "Creative Commons Attribution-NoDerivatives 4.0": "cc-by-nd",
    "Creative Comons Attribution NonCommercial NoDerivatives": "cc-by-nc-nd",
    "Creative Commons Attribution ShareAlike": "cc-by-sa",
    "SPDX-License-Identifier: Apache-2.0": "apache",
    "SPDX-License-Identifier: CC-BY-NC-ND-4.0 and more": "cc-by,cc-by-nc-nd",  # "cc by" is a phrase of the base
    "x SPDX-License-Identifier: MIT SPDX-License-Identifier: BSD-3-Clause": "bsd,mit",
    "SPDX-License-Identifier: MITX": "",
    "spdx license": "",
}


def test_longer_notices_win(spark):
    rows = list(enumerate(RELATIONS))
    got = by_id(scan_licenses(spark.createDataFrame(rows * 2, "doc_id long, text string")))
    assert {text: got[i][5] for i, text in rows} == RELATIONS
    spans = got[list(RELATIONS).index("x SPDX-License-Identifier: MIT SPDX-License-Identifier: BSD-3-Clause")][7]
    assert [(x.label, x.first_word, x.last_word) for x in spans] == [("mit", 1, 4), ("bsd", 5, 10)]


@pytest.mark.parametrize("unit", ["Licensed under the Apache License, Version 2.0. ", "mit license ", "licensed under "])
def test_long_texts_of_notices(spark, unit):
    n = 2_000_000 // len(unit)
    start = time.time()
    row = scan_licenses(spark.createDataFrame([(1, unit * n)], "doc_id long, text string")).drop("spans").first()
    assert time.time() - start < 20
    assert row.n_words == n * len(normal(unit.encode()).split()) and row.n_base == (0 if unit == "licensed under " else n)
    assert row.last_word == (None if row.n_base == 0 else row.n_words - (5 if "Apache" in unit else 2))


def test_equal_rows_and_parameters(spark):
    frame = spark.createDataFrame([(None, "a b c")] * 3 + [(2, None)], "doc_id long, text string")
    got = scan_licenses(frame, {"b c": "x"}, {"nothing to see here": "y"}).collect()
    assert sorted((r.doc_id is None, r.n_base, r.first_word, r.labels) for r in got) == [
        (False, 0, None, "")] + [(True, 1, 1, "x")] * 3
    assert license_scan.longest([]) == []
