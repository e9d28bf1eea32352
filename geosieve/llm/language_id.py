"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows to learn from. The regression is fitted on a bounded sample of them
with follow-the-regularised-leader updates and an elastic-net penalty, and its scores are calibrated by a temperature
fitted on a part of the sample that the weights did not see. The sample has at most about ``sample_rows`` rows, chosen by
a hash of key and text, and of each row the ``ROW_FEATURES`` heaviest n-grams (some 50 MB in all). Its rows are shared out
over the languages, so that a language of few rows in a million is learned like the others; the scores are set right
for the shares that the languages really have.

A text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing to learn from: no rows,
no language. Very long texts are counted whole. Repeated rows count each; equal rows get equal results; only
the key, the text and the language are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import small_batches

BITS = 15  # hashed n-grams of one to three characters
ORDERS = 3
SAMPLE_ROWS = 4000
ROW_FEATURES = 2048
LANGUAGES = 1000  # the most frequent ones are learned
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.01
CALIBRATION_SHARE = 5  # one sampled row in so many is kept for the temperature
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_ODD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and how often each occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found, mixed = np.zeros(1 << BITS, np.int64), np.zeros(len(c), np.uint32)
    for order in range(ORDERS):
        if len(c) <= order:
            break
        mixed = (mixed[: len(c) - order] + c[order:]) * _ODD[order]
        mixed ^= mixed >> np.uint32(15)
        found += np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF values of length 1, and a constant feature at the end."""
    at, n = ngram_counts(text)
    x = (1 + np.log(n)) * idf[at]
    return np.append(at, 1 << BITS), np.append(x / np.sqrt((x * x).sum()), 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int,
                      epochs: int = EPOCHS) -> np.ndarray:
    """Weights (features, classes) after FTRL-proximal updates; many are exactly 0."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w, seen = weights(z[at], n[at]), n[at]
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / ALPHA * w
            n[at] += g * g
    return weights(z, n)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits under which the true classes are likeliest."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    grid = np.geomspace(0.05, 20, 25)
    best = min(grid, key=loss)
    return float(min(np.geomspace(best / 1.3, best * 1.3, 25), key=loss))


class LanguageModel:
    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, heat: float, prior: np.ndarray):
        self.names, self.idf, self.weights, self.heat, self.prior = names, idf, weights, heat, prior

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        at, x = vector(text, self.idf)
        p = softmax(x @ self.weights[at] / self.heat + self.prior)
        return self.names[int(p.argmax())], float(p.max())


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, and the number of texts (at index -1 of the counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[ngram_counts(text)[0]] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         names=["feature", "n"])

    counts = np.zeros((1 << BITS) + 1, np.int64)
    for feature, n in texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        counts[feature] = n  # as many rows as features at most
    return counts[:-1], int(counts[-1])


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows of each language to take: all of the rarest, an equal share of the others, ``rows`` in all."""
    out = {}
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, -(-(rows - sum(out.values())) // (len(counts) - i)))
    return out


def fit(rows: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_rows: int = SAMPLE_ROWS, row_features: int = ROW_FEATURES) -> LanguageModel:
    """A model of the rows for which ``learn`` holds and text and language are not null."""
    small_batches(rows.sparkSession)
    rows = rows.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("y"))
    counts, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + counts)) + 1
    top = rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(LANGUAGES)
    known = {r["y"]: r["count"] for r in top.collect()}
    wanted = quotas(known, sample_rows)
    share = {y: int((1 << 30) * wanted[y] / n) for y, n in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # copies of a row hash alike; each task takes one of them
        for batch in batches:
            hashes = batch.column(2).to_pylist()
            new = [i for i, h in enumerate(hashes) if h not in met and not met.add(h)]
            batch, vectors = batch.take(pa.array(new, pa.int64())), []
            for t in batch.column(0).to_pylist():
                at, x = vector(t, idf)
                if len(at) > row_features:
                    heavy = np.sort(np.argpartition(-x[:-1], row_features - 2)[:row_features - 1])
                    at, x = np.append(at[heavy], at[-1]), np.append(x[heavy], x[-1])
                vectors.append((at.astype(np.uint16).tobytes(), x.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array([v[k] for v in vectors], pa.binary()) for k in (0, 1)]],
                names=["y", "at", "x"])

    shares = rows.sparkSession.createDataFrame(list(share.items()), "y string, share long")  # a row per language
    rows = rows.join(F.broadcast(shares), "y").withColumn("h", F.xxhash64(F.lit("sample"), "key", "text"))
    sampled = rows.where(F.pmod("h", F.lit(1 << 30)) < F.col("share")).select("text", "y", "h")
    found = sampled.mapInArrow(run, "y string, at binary, x binary").collect()
    names = sorted({r.y for r in found})
    found = sorted(((np.frombuffer(r["at"], np.uint16).astype(int), np.frombuffer(r["x"], np.float32).astype(float),
                     names.index(r["y"])) for r in found), key=lambda v: (v[2], v[0].tobytes(), v[1].tobytes()))
    order = np.random.default_rng(5).permutation(len(found))
    held, seen = [[found[i] for j, i in enumerate(order) if (j % CALIBRATION_SHARE == 0) == part]
                  for part in (True, False)]
    weights = follow_the_leader(seen, len(names), (1 << BITS) + 1)
    logits = np.array([x @ weights[at] for at, x, _ in held])
    heat = temperature(logits, np.array([y for *_, y in held], int))
    taken = np.bincount([y for *_, y in found], minlength=len(names))
    prior = np.log(np.array([known[y] for y in names], float)) - np.log(np.maximum(taken, 1))
    return LanguageModel(names, idf, weights, heat, prior - (prior.max() if len(prior) else 0))


def predicted(model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def languages(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return languages(text)


def held_out(key: str = "doc_id", mod: int = 3, remainder: int = 1) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))
