"""Aligns the tokens of two tokenizers, text by text, and weighs aligned pairs by the documents that hold them.

Documents are shuffled by their full text and each distinct text is tokenised and aligned once, with its multiplicity.
Both token sequences cut the same bytes, so two tokens are linked where their byte ranges overlap: each stretch between
neighbouring token ends of either kind is one link. Places where both kinds end cut the text into groups.

A pair's count is the number of documents that hold it linked: its distinct texts, each weighted by its multiplicity.
Counts are aggregated before they are exchanged. They are broadcast to the texts' pairs if a count of their rows allows
it, otherwise the pairs are joined with hot ones salted. The measures of a text go back to its documents by the
SHA-256 of the text.

A text that is null, empty or not covered byte for byte by both tokenizers has no tokens and links: zeros and an empty
hash column. Rows without an id and repeated rows are documents of their own. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import small_batches, written
from geosieve.llm.packing import byte_of_character, encoder
from geosieve.sizing import BROADCAST_ROWS, sized_join

MEASURES = ("digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<long>, links array<long>")
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Tokens of both kinds and how they meet. ``a``: a byte-level BPE file, ``b``: a piece model that adds a space."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        byte = byte_of_character()
        self.first = encoder(a)
        self.second = sentencepiece.SentencePieceProcessor(model_file=b)
        vocabulary = self.first.library.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        # an id as it is written within and at the end of its side of a group
        self.text_a = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.text_b = [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both kinds, or None if one does not give the text's bytes back."""
        if not text:
            return None
        spaced = " " + text
        whole = spaced.encode()
        a = np.frombuffer(self.first(spaced), "<u4").astype(np.int64)
        b = self.second.encode(text, num_threads=1)
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return a, np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray, np.ndarray]:
        """The number of groups, their digest, and the a and b places of each link."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")  # two runs in order
        new = np.append(ends[1:] != ends[:-1], True)
        both, ends = ends[:-1][~new[:-1]], ends[new]
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        # of each group first the a ids, then the b ids
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable").tolist()
        written_ids = [self.text_a[i] for i in (2 * a + last_a).tolist()]
        written_ids += [self.text_b[i] for i in (2 * b + last_b).tolist()]
        line = "".join([written_ids[i] for i in order])[:-1]
        return len(both), hashlib.sha256(line.encode()).hexdigest(), link_a, link_b


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct text that is not null or empty, and how many rows have it."""
    known = docs.select(F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    return known.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))


def aligned_texts(texts: DataFrame, a: str, b: str) -> DataFrame:
    """Measures of each (text, copies): distinct linked id pairs (a in the high 32 bits) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            out = []
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = both.tokens(text)
                if found is None:
                    continue
                groups, digest, link_a, link_b = both.align(*found)
                pairs, links = np.unique(found[0][link_a] << 32 | found[1][link_b], return_counts=True)
                out.append((hashlib.sha256(text.encode()).digest(), copies, len(found[0]), len(found[1]), groups,
                            len(link_a), digest, pairs, links))
            columns = list(zip(*out)) if out else [[]] * 9
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32),
                                              np.concatenate([*c, np.empty(0, np.int64)])) for c in columns[7:]]
            kinds = [pa.binary(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], *lists],
                                             names=[x.split()[0] for x in MEASURES.split(", ")])

    return texts.mapInArrow(run, MEASURES)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair of its a id has a higher count)."""
    rows = aligned.select("copies", F.explode("pairs").alias("pair"))
    counts = written(rows.groupBy("pair").agg(F.sum("copies").alias("count")))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row per id of the vocabulary at most
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text",
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row per row of ``docs``."""
    c = F.col
    small_batches(docs.sparkSession)
    aligned = written(aligned_texts(distinct_texts(docs, text), a, b))
    counts = written(pair_counts(aligned))
    held = aligned.select("digest", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select(
        "digest", c("x.pairs").alias("pair"), c("x.links").alias("links"))
    held = sized_join(held, counts, ["pair"], "inner", ["digest"], "sized", broadcast_rows)
    sums = held.groupBy("digest").agg(F.sum(c("links") * c("best").cast("long")).alias("n_best"),
                                      F.sum(c("links") * c("count")).alias("count_sum"))
    kept = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measured = written(aligned.drop("pairs", "links", "copies").join(sums, "digest"))
    rows = docs.select(c(key).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).join(measured, "digest", "left")
    return rows.select("doc_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in kept],
                       F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
