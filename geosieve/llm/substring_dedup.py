"""Removes passages that an earlier document has too, by difference-cover anchors.

A passage is a window of 50 words. Hashes of 20 words are taken only where the position modulo 31 is in a difference
cover: for any two positions some shift below 31 brings both onto the cover, so two equal windows share an aligned
anchor inside them. Only windows around anchors that two documents share are then hashed in full (extension), and a
window goes if its sequence also starts in a document with a smaller id.

Documents with equal word sequences are found first; of those, only the smallest id is extended. One exchange carries
the anchors and one the candidate windows; anchors and windows that a sample shows to be in very many documents do not
take part: such an anchor is shared for certain, and such a window's smallest document is found by an aggregate. The
texts are exchanged once, and kept from there on only for documents with a shared anchor.

A null text has no words. Rows without an id lose nothing and cost others nothing. Rows that repeat an id must be equal
rows, and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.llm.common import as_bytes, hash_words, mix, slices, small_batches, span_hashes, span_sums, written
from geosieve.sizing import HOT_KEYS, HOT_SAMPLE_ROWS, SAMPLE_ONE_IN

LENGTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is one of two of these
ANCHOR = LENGTH - PERIOD + 1

_COVERED = np.zeros(PERIOD, bool)
_COVERED[list(COVER)] = True


def _batches(kinds: str, texts_at: int, make):
    """A function for mapInArrow: ``make`` gets a slice of the rows and the hashed words of its texts."""
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(texts_at))
            for part in slices(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(make(rows, texts[part]), names=names)

    return run


def _summaries(docs: DataFrame) -> DataFrame:
    """n_words, a 128-bit digest of the word sequence, and the digest of the words joined by single spaces."""
    kinds = "doc_id long, n_words long, d1 long, d2 long, sha string"

    def make(rows: pa.RecordBatch, texts: list[bytes]) -> list[pa.Array]:
        joined = [b" ".join(x.split()) for x in texts]
        digests = [hashlib.sha256(x).digest() for x in joined]
        halves = np.frombuffer(b"".join(x[:16] for x in digests), np.int64).reshape(-1, 2)
        return [rows.column(0), pa.array([x.count(b" ") + 1 if x else 0 for x in joined], pa.int64()),
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([x.hex() for x in digests])]

    return docs.mapInArrow(_batches(kinds, 1, make), kinds)


def _anchor_places(n_words: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where anchors begin among the words of all texts, whose they are, and their place in the text."""
    n = np.diff(begin)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n_words) - begin[owner]
    i = np.flatnonzero(_COVERED[at % PERIOD] & (at + ANCHOR <= n[owner]) & (n[owner] >= LENGTH))
    return i, owner[i], at[i]


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that tell the texts apart too."""
    return mix(hashes ^ mix(owner.astype(np.uint64)))


def _anchors(docs: DataFrame) -> DataFrame:
    """The first place of each distinct anchor of each row (doc_id, text)."""
    kinds = "h long, doc_id long, at int"

    def make(rows: pa.RecordBatch, texts: list[bytes]) -> list[pa.Array]:
        words, begin = hash_words(texts)
        i, owner, at = _anchor_places(len(words), begin)
        h = span_hashes(span_sums(words), i, i + ANCHOR)
        first = np.sort(np.unique(_own(h, owner), return_index=True)[1])
        return [pa.array(h[first].view(np.int64)), rows.column(0).take(pa.array(owner[first])),
                pa.array(at[first].astype(np.int32))]

    return docs.mapInArrow(_batches(kinds, 1, make), kinds)


def _window_hashes(words: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and an independent 32-bit hash of the windows that begin at ``i``."""
    other = span_hashes(span_sums(mix(words ^ np.uint64(0xA0761D6478BD642F))), i, i + LENGTH)
    return span_hashes(span_sums(words), i, i + LENGTH), other >> np.uint64(32)


def _listed(begin: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places listed for each text, among the words of all texts, and whose they are."""
    owner = np.repeat(np.arange(len(begin) - 1), lists.value_lengths().to_numpy(zero_copy_only=False))
    return begin[owner] + lists.flatten().to_numpy(zero_copy_only=False), owner


def _windows(docs: DataFrame) -> DataFrame:
    """The first place of each distinct window around the anchors of each row (doc_id, text, ats)."""
    kinds = "h long, g int, doc_id long, at int"

    def make(rows: pa.RecordBatch, texts: list[bytes]) -> list[pa.Array]:
        words, begin = hash_words(texts)
        sums = span_sums(words)
        listed, whose = _listed(begin, rows.column(2))
        i, owner, _ = _anchor_places(len(words), begin)
        shared = np.isin(_own(span_hashes(sums, i, i + ANCHOR), owner),
                         _own(span_hashes(sums, listed, listed + ANCHOR), whose))
        i, owner = i[shared], owner[shared]
        edges = np.zeros(len(words) + 1, np.int64)
        low = np.maximum(i - PERIOD + 1, begin[owner])
        np.add.at(edges, low, 1)
        np.add.at(edges, np.maximum(np.minimum(i, begin[owner + 1] - LENGTH) + 1, low), -1)
        i = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        owner = np.searchsorted(begin, i, "right") - 1
        h, g = _window_hashes(words, i)
        first = np.sort(np.unique(_own(h ^ g << np.uint64(32), owner), return_index=True)[1])
        i, owner, h, g = i[first], owner[first], h[first], g[first]
        return [pa.array(h.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32)),
                rows.column(0).take(pa.array(owner)), pa.array((i - begin[owner]).astype(np.int32))]

    return docs.mapInArrow(_batches(kinds, 1, make), kinds)


def _cut(docs: DataFrame) -> DataFrame:
    """The words of each row (doc_id, text, ats) that no window equal to one at ``ats`` covers."""
    kinds = "doc_id long, n_removed long, kept_sha256 string, kept_text string"

    def make(rows: pa.RecordBatch, texts: list[bytes]) -> list[pa.Array]:
        words, begin = hash_words(texts)
        n = np.diff(begin)
        owner = np.repeat(np.arange(len(texts)), n)
        i = np.flatnonzero(np.arange(len(words)) + LENGTH <= begin[owner + 1])
        listed, whose = _listed(begin, rows.column(2))
        every, wanted = _window_hashes(words, i), _window_hashes(words, listed)
        gone = i[np.isin(_own(every[0] ^ every[1] << np.uint64(32), owner[i]),
                         _own(wanted[0] ^ wanted[1] << np.uint64(32), whose))]
        edges = np.zeros(len(words) + 1, np.int64)
        edges[gone] = 1
        np.add.at(edges, gone + LENGTH, -1)
        keep = np.cumsum(edges)[:-1] <= 0
        kept = [b" ".join([w for w, x in zip(t.split(), keep[a:b].tolist()) if x])
                for t, a, b in zip(texts, begin, begin[1:])]
        removed = n - np.diff(np.append(0, np.cumsum(keep))[begin])
        return [rows.column(0), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                pa.array([x.decode() for x in kept], pa.string())]

    return docs.mapInArrow(_batches(kinds, 1, make), kinds)


def _hot(rows: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """The keys with the most rows in a sample of documents, a bounded number; for most corpora there are none."""
    found = rows.groupBy(*keys).count().where(F.col("count") >= floor).orderBy(F.desc("count"), *keys).limit(HOT_KEYS)
    return written(found.select(*keys))


def _sampled(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_IN)) == 0)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", floor: int = HOT_SAMPLE_ROWS
                   ) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and kept_text (null: nothing
    was removed), one row per row of ``docs``."""
    c = F.col
    small_batches(docs.sparkSession)
    docs = docs.select(c(key).cast("long").alias("doc_id"), c(text).alias("text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    every = written(_summaries(docs))
    first = every.where(c("doc_id").isNotNull() & (c("n_words") >= LENGTH)).groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = written(first)  # so that the join meets plain exchanges and adaptive execution splits a document's copies
    copies = written(every.join(first, ["d1", "d2"]).where("doc_id > first").select("doc_id").distinct())

    hot = _hot(_anchors(_sampled(known)), ["h"], floor)
    anchors = _anchors(known).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "h", "left")
    same = Window.partitionBy("h")
    shared = anchors.where("hot IS NULL").select(
        "doc_id", "at", F.min("doc_id").over(same).alias("low"), F.max("doc_id").over(same).alias("high")).where(
        "low < high").select("doc_id", "at").union(anchors.where("hot").select("doc_id", "at"))
    places = shared.groupBy("doc_id").agg(F.collect_list("at").alias("ats")).join(copies, "doc_id", "left_anti")
    likely = written(known.join(places, "doc_id").select("doc_id", "text", "ats"))

    keys = ["h", "g"]
    hot = _hot(_windows(_sampled(likely)), keys, floor)
    windows = _windows(likely)
    lows = windows.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.min("doc_id").alias("hot_low"))  # as few as hot
    windows = windows.join(F.broadcast(lows), keys, "left")
    same = Window.partitionBy(*keys)
    repeated = windows.where("hot_low IS NULL").withColumn("low", F.min("doc_id").over(same)).where(
        "low < doc_id").select("doc_id", "at").union(
        windows.where("hot_low < doc_id").select("doc_id", "at"))
    places = repeated.groupBy("doc_id").agg(F.collect_set("at").alias("ats"))
    cut = _cut(likely.select("doc_id", "text").join(places, "doc_id").select("doc_id", "text", "ats"))
    cut = cut.groupBy("doc_id").agg(*[F.max(x).alias(x) for x in ("n_removed", "kept_sha256", "kept_text")])
    gone = copies.select("doc_id", F.lit(True).alias("gone"))
    out = every.select("doc_id", "n_words", "sha").join(cut, "doc_id", "left").join(gone, "doc_id", "left")
    return out.select(
        "doc_id", "n_words",
        F.when(c("gone"), c("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(c("gone"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(c("gone"), F.lit("")).otherwise(c("kept_text")).alias("kept_text"))
