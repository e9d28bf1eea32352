"""Packs tokenised documents into training sequences by the sum-of-squares rule.

Documents become token ids plus an end id; only longer ones are cut, into pieces of a full sequence, of which the first
may be shorter. Pieces are dealt into packing groups by a hash, each some thousand pieces whatever the input's size.
In a group, longest first, a piece goes into the open sequence for which the sum of the squared counts of open
sequences per residual gap becomes smallest; a new sequence is opened only if none has room. So each group wastes about
one sequence, and no task sees more than a group.

Ids are those of the ``tokenizers`` library. With ``added_tokens``, its default setting, an added token such as an end
mark in a text is that token; without, it is ordinary characters. The library encodes the texts with such a token and
those with a very long gap; a faster encoder with the same ids encodes the others. Words between spaces are tokenised
once per worker and kept: in this family of pre-tokenisers a space before a visible character always begins a token. A
null text is an empty one (just the end id); equal rows are packed each on its own. Very long texts are encoded whole and
cut; pieces of equal length are taken by key, piece and checksum; no rows give no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geosieve.llm.common import small_batches, written

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 8192
KEPT_WORDS = 200_000

_DOUBLE_GAP = re.compile(r" (?:\s|$)")
_LONG_GAP = re.compile(r"(?<!\s)\s{10000}")  # the fast encoder fails at some hundred thousand
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def byte_of_character() -> dict[str, int]:
    """The visible characters that byte-level vocabularies write for bytes: themselves, or those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, added_tokens: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = byte_of_character()
        special = {x["content"] for x in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added_tokens
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.special.search(text) or _LONG_GAP.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _DOUBLE_GAP.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        words, out = self.words, [self.ids(first)]
        for word in rest:
            ids = words.get(word)
            if ids is None:
                ids = self.ids(" " + word)
                if len(words) < KEPT_WORDS:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    if (path, added_tokens) not in _ENCODERS:
        _ENCODERS[path, added_tokens] = Encoder(path, added_tokens)
    return _ENCODERS[path, added_tokens]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 key: str = "doc_id", text: str = "text", added_tokens: bool = False) -> DataFrame:
    """The pieces of all documents: the key, piece, start, length, ids_crc32 and the ids themselves (``ids``)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType
    end = np.array([end_id], "<u4").tobytes()
    fields = [(key, to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("ids", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(t) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    out.append((k, i, a, b - a, zlib.crc32(part), part))
            columns = zip(*out) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                             names=[n for n, _ in fields])

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, "
                                "ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset in it, pieces placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[n:capacity]) + n
        if len(gaps):
            left = gaps - n
            gap = int(gaps[np.argmin(np.where(left > 0, 2 * count[left] + 1, 0) + 1 - 2 * count[gaps])])
            own = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, own, made = capacity, made, made + 1
        sequence[i], offset[i] = own, capacity - gap
        if gap > n:
            open_by_gap[gap - n].append(own)
            count[gap - n] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, key: str = "doc_id"
         ) -> DataFrame:
    """``pieces`` with sequence_id and offset; of their columns, ids stay out."""
    # tokenise once: the count decides the number of groups
    pieces = written(pieces.drop("ids").withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups)))
    # repeated rows hash alike: where they crowd a group, its rows are dealt out by their stored numbers too
    crowded = pieces.groupBy("_group").count().where(F.col("count") > 2 * group_pieces).select(
        "_group", F.lit(True).alias("_crowded"))
    dealt = F.when(F.col("_crowded"), F.pmod(F.xxhash64(key, "piece", "ids_crc32", "_row"), F.lit(groups))).otherwise(
        F.col("_group"))
    pieces = pieces.join(F.broadcast(crowded), "_group", "left").withColumn("_group", dealt).drop("_row", "_crowded")
    order = ["length", key, "piece", "ids_crc32"]

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=[False, True, True, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = (rows["_group"].to_numpy() << 32) + sequence, offset
        return rows.drop(columns="_group")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_group")
    return (pieces.groupBy("_group")
            .applyInPandas(place, f"{fields}, sequence_id long, offset long"))
