"""Toxicity scores over texts restored by a noisy-channel model.

Places that look disguised (letters replaced by digits or symbols, single letters set apart, letters repeated) become
lattices: each character stands for itself, for a letter it resembles, or for nothing, at a cost. The best path under
a character trigram model, counted over all documents, is found by Viterbi. Text without such places has one path only
and stays as it is. A logistic regression over the restored text, with follow-the-regularised-leader
updates and an L1 penalty, gives the score. Its features are the words and their beginnings (inflected forms share
one) that are in at least five sampled rows, in however small a part of them, and whose label counts differ most from
chance; it is fitted on a bounded sample of the labelled rows (``sample_rows``) with a bounded number of features
(``max_features``).

A null or empty text gets the score of a text without words. Very long texts are restored place by place and scored
whole; equal texts have equal scores, repeated rows count each in the trigrams; no rows give no rows, and columns but
the key, the text and the labels are not read. Without labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import as_bytes, small_batches, written

THRESHOLD = 0.3
SAMPLE_ROWS = 12_000
LEAST_ROWS, LEAST_CHI = 5, 11.0  # a feature must occur in so many sampled rows, and differ so much by label
MAX_FEATURES = 2000
BEGINNINGS = range(4, 10)  # lengths of words' beginnings, in bytes
EPOCHS, ALPHA, BETA, L1, L2 = 16, 1.0, 1.0, 1.0, 0.001

# what a character may stand for besides itself
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
REPLACED, SHORTENED, KEPT = 1.0, 0.5, 7.0  # costs, in nats
# a mark between characters is nothing or a gap: where characters stand apart, or else, and where marks are doubled
MARKS = {"apart": (0.2, 4.0), "inside": (1.0, 0.0), "double": (4.0, 0.5)}

_SIGN = r"[a-z0-9@$!|+]"
DISGUISED = re.compile(
    # letters and signs mixed, not only signs behind a word
    rf"(?:[a-z]+(?:[0-9@$!|+]+[a-z]|[0-9])|[0-9@$!|+]+[a-z])(?:{_SIGN}*[a-z0-9])?"
    # single characters set apart
    rf"|(?<![^\s._*-])(?:{_SIGN}[ ._*-]{{1,2}}){{3,}}{_SIGN}(?![^\s.,;:?!_*-])"
    # a word cut by marks
    r"|[a-z]+(?:[._*][a-z]+)+"
    # repeated letters
    r"|[a-z]*([a-z])\1\1[a-z]*")
_NOT_LETTERS = bytes(0x20 if b < 128 and not chr(b).isalpha() else b for b in range(256))
AROUND = 64  # bytes beside a suspicious place that are searched with it

CLASSES = 28  # a to z, other letters, and what is between words (0)
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_KIND = np.zeros(256, np.uint8)  # 1: letter, 2: digit, 4: other sign, 8: mark, 16: white space
_KIND[97:123] = 1
for _characters, _bit in (("0123456789", 2), ("@$!|+", 4), (" ._*-", 8), (" \t\n\x0b\x0c\r", 16)):
    _KIND[[ord(c) for c in _characters]] |= _bit


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Character trigrams of all texts: counted per task, then summed; as many rows as trigrams reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                c = _CLASS[np.frombuffer(b" " + text + b" ", np.uint8)]
                c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))].astype(np.int64)
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         names=["trigram", "n"])

    counts = np.zeros(CLASSES ** 3, np.int64)
    for trigram, n in texts.mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n")).collect():
        counts[trigram] = n
    return counts


def suspicious(text: bytes) -> list[tuple[int, int]]:
    """Parts of a lower-case text, from gap to gap, outside which no place can look disguised."""
    if len(text) < 3:
        return [(0, len(text))] if text else []
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    letter, digit, sign, mark = (kind & 1) > 0, (kind & 2) > 0, (kind & 6) > 0, (kind & 8) > 0
    found = np.zeros(len(raw), bool)
    found[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & digit[1:])
    middle = letter[2:] & letter[:-2] & (((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]))
                                         | (mark[1:-1] & (raw[1:-1] != 0x20) & (raw[1:-1] != 0x2D)))
    found[:-2] |= middle
    alone = (letter | sign)[1:-1] & (kind[:-2] >= 8) & (kind[2:] >= 8)
    if len(alone) > 2:
        found[3:-1] |= alone[2:] & (alone[:-2] | (np.append(False, alone[:-3]) if len(alone) > 3 else False))
    at = np.flatnonzero(found)
    if not len(at):
        return []
    gaps = np.flatnonzero(kind >= 16)
    left = np.searchsorted(gaps, np.maximum(at - AROUND, 0), "right") - 1
    right = np.searchsorted(gaps, at + AROUND)
    begin = np.where(left >= 0, gaps[np.maximum(left, 0)], 0) if len(gaps) else np.zeros(len(at), int)
    end = np.where(right < len(gaps), gaps[np.minimum(right, len(gaps) - 1)], len(raw)) if len(gaps) \
        else np.full(len(at), len(raw))
    new = np.append(True, begin[1:] > end[:-1])
    starts = np.flatnonzero(new)
    return list(zip(begin[starts].tolist(), np.append(end[starts[1:] - 1], end[-1]).tolist()))


class Restorer:
    """Viterbi decoding of disguised places under a trigram model."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + CLASSES)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 2 * p2[None]) / (three.sum(2, keepdims=True) + 2)
        self.cost = (-np.log(p3)).tolist()

    @staticmethod
    def arcs(place: str) -> list[list[tuple[str, float]]]:
        """For each step of the lattice, what it may be read as and the cost."""
        out, i = [], 0
        apart = len(place) > 5 and all(x in " ._*-" for x in place[1:2]) and not place[2:4].isalpha()
        while i < len(place):
            c, run = place[i], 1
            while i + run < len(place) and place[i + run] == c:
                run += 1
            if c in LOOKS_LIKE:
                # as often as it stands there, or once
                out += [[(x, REPLACED) for x in LOOKS_LIKE[c]] + [(" ", KEPT)]] * run
            elif c.isalpha():
                if run > 2:
                    out.append([(c, SHORTENED), (c * 2, SHORTENED), (c * run, KEPT)])
                else:
                    out += [[(c, 0.0)]] * run
            else:
                while i + run < len(place) and place[i + run] in " ._*-":
                    run += 1
                nothing, gap = MARKS["inside" if not apart else "double" if run > 1 else "apart"]
                out.append([("", nothing), (" ", gap)])
            i += run
        return out

    def restore(self, place: str) -> str:
        paths = {(0, 0): (0.0, "")}
        for arcs in [*self.arcs(place), [(" ", 0.0)]]:
            reached: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in paths.items():
                for read, extra in arcs:
                    x, y, total = a, b, cost + extra
                    for ch in read:
                        z = ord(ch) - 96 if ch != " " else 0
                        if z or y:  # gaps in a row are one gap
                            total += self.cost[x][y][z]
                            x, y = y, z
                    if (x, y) not in reached or total < reached[x, y][0]:
                        reached[x, y] = (total, text + read)
            paths = reached
        return min(paths.values())[1].strip()


class ToxicityModel:
    def __init__(self, restorer: Restorer):
        self.restorer, self.weights, self.beginnings, self.bias, self.known = restorer, {}, {}, None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _restored(self, m: re.Match) -> str:
        place = m[0]
        if place not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[place] = self.restorer.restore(place)
        return self.known[place]

    def restore(self, text: bytes) -> bytes:
        """The text in lower case with its disguised places restored; only parts around suspicious bytes are searched."""
        text = text.lower()
        out, last = [], 0
        for begin, end in suspicious(text):
            out += [text[last:begin], DISGUISED.sub(self._restored, text[begin:end].decode()).encode()]
            last = end
        return b"".join([*out, text[last:]]) if out else text

    def words(self, text: str | None) -> set[bytes]:
        return set(self.restore((text or "").encode()).translate(_NOT_LETTERS).split())

    def features(self, text: str | None) -> set[bytes]:
        """The words, and their beginnings marked by a star."""
        words = self.words(text)
        return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in BEGINNINGS))

    def set_weights(self, weights: dict[bytes, float], bias: float) -> None:
        self.bias, self.weights = bias, weights
        self.beginnings = {k: {w[:-1] for w in weights if w[-1:] == b"*" and len(w) == k + 1} for k in BEGINNINGS}

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        words, weights = self.words(text), self.weights
        found = [weights[w] for w in weights.keys() & words]
        for k, known in self.beginnings.items():
            if known:
                found += [weights[w + b"*"] for w in known.intersection({w[:k] for w in words if len(w) > k})]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.bias + sum(sorted(found))))))


def follow_the_leader(rows: list[tuple[np.ndarray, int]], features: int) -> np.ndarray:
    """FTRL-proximal weights of a binary logistic regression; the last feature is the constant, without a penalty."""
    z, n, l1 = np.zeros(features), np.zeros(features), np.full(features, L1)
    l1[-1] = 0

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            w = weights(z[at], n[at], l1[at])
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(z, n, l1)


def _selected(sample: DataFrame, model: ToxicityModel, max_features: int) -> list[bytes]:
    """The features of the sample (words, _y) whose counts by label differ most from chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        positive: Counter[bytes] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [b"", *model.features(text)]  # the empty one counts the rows
                n.update(found)
                if y:
                    positive.update(found)
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n[w] for w in names], pa.int64()),
                                          pa.array([positive[w] for w in names], pa.int64())], names=["w", "n", "p"])

    counts = sample.mapInArrow(run, "w binary, n long, p long").groupBy("w").agg(F.sum("n").alias("n"),
                                                                                 F.sum("p").alias("p"))
    counts = written(counts)
    total = counts.where(F.length("w") == 0).first()
    if total is None:
        return []
    share = total.p / total.n
    expected = F.col("n") * share
    chi = F.pow(F.col("p") - expected, 2) / (expected * (1 - share) + 1e-9)
    best = (counts.where((F.length("w") > 0) & (F.col("n") >= LEAST_ROWS) & (chi > LEAST_CHI))
            .orderBy(chi.desc(), "w").limit(max_features).collect())
    return sorted(bytes(r.w) for r in best)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
        label: str = "toxic", sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> ToxicityModel:
    """The trigram model of all ``docs`` and weights from the labelled rows for which ``learn`` (of the key) holds."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key), F.col(text).alias("_text"))
    model = ToxicityModel(Restorer(trigram_counts(docs.select("_text"))))
    labels = labels.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).alias("_y"))
    share = int((1 << 30) * min(1.0, sample_rows / max(1, labels.count())))
    # about sample_rows rows of two numbers: safe to broadcast
    chosen = labels.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < share)
    sample = docs.where(F.col("_text").isNotNull()).join(F.broadcast(chosen), key)
    sample = written(sample.select("_text", F.col("_y").cast("int").alias("_y")).distinct())  # copies count once
    names = _selected(sample, model, max_features)
    number = {w: i for i, w in enumerate(names)}

    @F.pandas_udf("binary")
    def coded(texts: pd.Series) -> pd.Series:
        found = [sorted(number[w] for w in model.features(t) if w in number) for t in texts]
        return pd.Series([np.array(x, np.int32).tobytes() for x in found])

    rows = sorted((bytes(r.x), r.y) for r in sample.select(coded("_text").alias("x"), F.col("_y").alias("y")).collect())
    if rows:
        weights = follow_the_leader([(np.append(np.frombuffer(x, np.int32), len(names)), y) for x, y in rows],
                                    len(names) + 1)
        model.set_weights({w: float(x) for w, x in zip(names, weights) if x}, float(weights[-1]))
    return model


def scored(model: ToxicityModel, text: Column) -> Column:
    """The score of each text."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return scores(text)
