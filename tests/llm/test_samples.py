"""What the models learn from is bounded and reaches rare rows; near-duplicates of template texts; rare copies."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosieve.llm import language_id, near_dedup
from tests.llm import reference


def test_quotas():
    assert language_id.quotas({"a": 1000, "b": 10, "c": 500}, 300) == {"b": 10, "c": 145, "a": 145}
    assert language_id.quotas({"a": 3, "b": 2}, 100) == {"a": 3, "b": 2}
    assert language_id.quotas({}, 100) == {}
    r = random.Random(3)
    for _ in range(200):
        counts = {str(i): r.randrange(1, 1000) for i in range(r.randrange(1, 30))}
        got = language_id.quotas(counts, 500)
        assert sum(got.values()) <= max(500, len(counts)) and sum(got.values()) >= min(500, sum(counts.values()))
        assert all(1 <= got[k] <= n for k, n in counts.items())


def words_of(letters: str, n: int, r: random.Random) -> str:
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(n))


def test_rare_languages_are_learned(spark):
    r = random.Random(8)
    rows = [(i, words_of("abcdefgh", 12, r), "common") for i in range(3000)]
    rows += [(10_000 + i, words_of("stuvwxyz", 12, r), "rare") for i in range(9)]
    rows += [(20_000, "repeated row", "common")] * 500 + [(None, None, "rare"), (5, "text", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(frame, F.lit(True), sample_rows=60)
    assert model.names == ["common", "rare"]
    assert model.predict(words_of("stuvwxyz", 12, r))[0] == "rare"
    assert model.predict(words_of("abcdefgh", 12, r))[0] == "common"
    # what looks like neither is likelier of the frequent language
    assert model.predict("1 mm 2")[0] == "common"


def test_long_rows_give_few_features(spark):
    r = random.Random(9)
    alphabet = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    rows = [(i, words_of(alphabet, 4000, r), "zh") for i in range(3)] + [(9, "some plain text", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame, F.lit(True), row_features=100)
    assert (np.abs(model.weights).sum(1) > 0).sum() <= 4 * 100
    assert model.predict("some text")[0] == "en"


def templates(n: int, r: random.Random) -> list[str]:
    """Texts of 200 words with 40 slots of three values each."""
    fixed = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(n):
        text = list(fixed)
        for slot in range(40):
            text[5 * slot + 2] = f"v{slot}x{r.randrange(3)}"
        out.append(" ".join(text))
    return out


def test_template_texts_are_told_apart_by_signatures(spark, monkeypatch):
    """Below the threshold, few pairs reach the texts; links among them stay."""
    r, compared = random.Random(12), []
    texts = templates(200, r)
    near = texts[0].replace("w0 ", "other ")
    rows = list(enumerate([*texts, near]))
    plain = near_dedup.confirmed

    def counted(pairs, *args):
        compared.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(frame, width=2).collect()}
    assert got == reference.near(rows)
    assert sum(compared) < 0.1 * len(rows) * (len(rows) - 1) / 2  # measured: 5.2 %


@pytest.mark.parametrize("width", [2, 5])
def test_no_link_is_lost_at_the_threshold(spark, width):
    """Pairs just at or above 0.8, in chains and among strangers."""
    r, rows = random.Random(width), []
    for group in range(60):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(4):
            text = list(base)
            # one changed word costs ``width`` shingles of either side
            for at in r.sample(range(0, 120, width), r.randrange(0, 14 // width + 2)):
                text[at] = f"x{r.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame, width=width).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(width)))) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i // 4 * 4, i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert links > 40 and got == {i: find(i) for i in range(len(rows))}
